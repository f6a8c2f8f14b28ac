"""From lines of law text to articles, elements, versions and graph rows.

A line's kind follows from its wording. Structure is carried down with window functions over each
law's lines, so no tree is built and every law is one window group, as large as its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lexlake.functions.numbers import with_article_number
from lexlake.functions.text import ARTICLE_WORDS, bound, change_id, fold, is_digits, title_words
from lexlake.operators.versions import closed
from lexlake.session import partitions, written

#: Headings, the wider first. A section is told from a sentence by the ordinal that follows the word.
STRUCTURE = ["libro", "titulo", "capitulo", "seccion", "subseccion"]
ARTICLES = ["articulo", "articulo_unico", "anexo", "disposicion"]
#: Beginnings of ordinals as they stand in headings of sections.
ORDINALS = ["unic", "primer", "segund", "tercer", "cuart", "quint", "sext", "septim", "octav", "noven", "decim", "undecim", "duodecim"]
#: Kinds of enumerated lines, the wider first.
ITEMS = ["apartado_numerico", "apartado_alfa", "ordinal_alfa", "ordinal_numerico"]
#: Lines to a partition, and the deepest level that ``elements`` gives.
LINES, DEEPEST = 200_000, 4


def item_kind(mark: Column, followed: Column) -> Column:
    """The kind of a line by its first word, in lower case: digits and a dot, a letter and a bracket (text must follow either), digits, dots and an ordinal
    sign; null without such a mark."""
    stem, sign = F.substring(mark, F.lit(1), F.char_length(mark) - 1), F.substring(mark, -1, 1)
    dotted = stem.endswith(".") & is_digits(F.rtrim(stem, F.lit(".")))
    kind = F.when((sign == ".") & is_digits(stem) & followed, ITEMS[0])
    kind = kind.when((sign == ")") & (F.char_length(stem) == 1) & stem.between("a", "z") & followed, ITEMS[1])
    return kind.when((sign == "ª") & dotted, ITEMS[2]).when((sign == "º") & dotted, ITEMS[3])


def classified(lines: DataFrame) -> DataFrame:
    """``lines`` with node_type, from a line's first word and what follows it."""
    # a column for each step: what several conditions read is worked out once for a line
    rows = lines.withColumn("_low", F.lower(F.trim("text"))).withColumn("_line", fold(F.col("_low")))
    rows = rows.withColumns({"_mark": F.regexp_extract("_low", r"^(\S+)", 1), "_head": F.regexp_extract("_line", r"^(\S+)", 1)})
    rows = rows.withColumns({"_word": F.rtrim("_head", F.lit(".")), "_rest": F.btrim(F.substr("_line", F.char_length("_head") + 1))})
    head, word, rest = F.col("_head"), F.col("_word"), F.col("_rest")
    follows = F.regexp_extract(rest, r"^(\S+)", 1)
    ordinal = F.rlike(follows, F.lit("^(" + "|".join(ORDINALS) + ")[oa]?\\W*$|^[0-9]+[.]?ª")) | F.rlike(rest, F.lit("^[0-9]+[.]? ª"))
    one_name = F.rlike(rest, F.lit("^([ivx]+|[0-9]+|[a-z])?[.]?$"))
    spelled = F.rlike(rest, F.lit(r"^[a-z]+( y [a-z]+)? ?[.]?$"))
    kind = F.when(F.col("kind") == "table", "table")
    kind = kind.when(word.isin("disposicion", "libro", "titulo", "capitulo") & (head == word) & (rest != ""), word)
    kind = kind.when(word.isin("seccion", "subseccion") & ordinal, word).when((word == "anexo") & one_name, word)
    article = F.when(follows.startswith("unico"), "articulo_unico").when(F.rlike(follows, F.lit("^[0-9]")) | spelled, "articulo")
    kind = F.coalesce(kind, F.when(word.isin("articulo", "art"), article), item_kind(F.col("_mark"), rest != ""), F.lit("parrafo"))
    return rows.select(*lines.columns, kind.alias("node_type"))


def structured(lines: DataFrame) -> DataFrame:
    """Classified lines with path, the headings above each, outermost first. A heading ends those below its rank."""
    order = Window.partitionBy("law_id").orderBy("block_no", "version_no", "line_no")
    rows = lines.withColumn("_at", F.row_number().over(order))
    for name in STRUCTURE:
        own = F.when(F.col("node_type") == name, F.struct("_at", "text"))
        rows = rows.withColumn(f"_{name}", F.last(own, ignorenulls=True).over(order))
    kept = []
    for k, name in enumerate(STRUCTURE):
        above = [F.coalesce(F.col(f"_{s}._at"), F.lit(0)) for s in STRUCTURE[:k]]
        alive = F.lit(True) if not above else F.col(f"_{name}._at") > (F.greatest(*above) if len(above) > 1 else above[0])
        kept.append(F.when(alive & (F.col("node_type") != name), F.initcap(F.lower(F.col(f"_{name}.text")))))
    return rows.withColumn("path", F.array_join(F.array_compact(F.array(*kept)), ", ")).drop("_at", *[f"_{s}" for s in STRUCTURE])


def article_versions(lines: DataFrame) -> DataFrame:
    """One row per version of every article: law_id, block_id, article_id, version_no, name, clean_number, path,
    source_id, valid_from, valid_to, prev_id, next_id, full_text.

    Lines of a block belong to its article; versions of a block are a chain, each in force until the next.
    """
    rows = structured(classified(lines))
    keys = ["law_id", "block_no", "block_id", "version_no", "source_id", "valid_from"]
    article = F.col("node_type").isin(ARTICLES)
    body = F.array_sort(F.collect_list(F.when(~article, F.struct("line_no", "text"))))
    out = rows.groupBy(*keys).agg(
        F.min_by(F.when(article, F.col("text")), F.when(article, F.col("line_no"))).alias("name"),
        F.min_by(F.when(article, F.col("node_type")), F.when(article, F.col("line_no"))).alias("node_type"),
        F.min_by("path", "line_no").alias("path"),
        F.array_join(F.transform(body, lambda x: x["text"]), "\n\n").alias("full_text"),
    )
    out = out.filter("name IS NOT NULL")
    out = with_article_number(out, "name", "clean_number").withColumn("article_id", F.concat_ws("_", "law_id", "block_id", F.col("version_no").cast("string")))
    start = F.try_to_date("valid_from", "yyyyMMdd").cast("timestamp_ntz")
    return closed(out.withColumn("_start", start).drop("valid_from"), ["law_id", "block_id"], "article_id", "_start").drop("_start")


def title_numbers(title: Column) -> Column:
    """The article numbers that a block's title names: one of 'Artículo 3' (a word may follow), all of 'Artículos 3 a 5' and of '7, 8 y 9'; null of
    any other title."""

    def read(words: Column) -> Column:
        is_article = F.rtrim(F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.lit(".")).isin(ARTICLE_WORDS)
        return F.when(is_article, bound(F.transform(F.slice(words, 2, 1 << 30), lambda w: F.rtrim(w, F.lit(".º°"))), told))

    def told(parts: Column) -> Column:
        numbers = F.transform(F.filter(parts, is_digits), lambda w: w.try_cast("int"))
        return bound(F.struct(parts.alias("parts"), numbers.alias("numbers"), F.filter(parts, lambda w: ~is_digits(w)).alias("between")), listed)

    def listed(x: Column) -> Column:
        parts, numbers, between = x["parts"], x["numbers"], x["between"]
        in_turn = F.forall(F.transform(parts, lambda w, i: is_digits(w) == (i % 2 == 0)), lambda x: x) & (F.size(parts) % 2 == 1)
        last = F.get(between, F.size(between) - 1)
        commas = (last == "y") & F.forall(F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0))), lambda w: w == ",")
        ranged = (F.size(parts) == 3) & (last == "a") & (numbers[0] <= numbers[1])
        single = (F.size(numbers) == 1) & (F.size(parts) <= 2) & is_digits(F.get(parts, F.lit(0)))
        several = F.when(in_turn & ranged, F.sequence(F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1)))).when(in_turn & commas & (F.size(numbers) > 1), numbers)
        return F.when(single, numbers).otherwise(several)

    return bound(title_words(F.replace(title, F.lit(","), F.lit(" , "))), read)


def distributed(lines: DataFrame) -> DataFrame:
    """``lines`` where the versions of a block with a compound title go to the blocks of its articles, titled as
    these are, and the compound block goes.

    The lines are computed once and kept in the shared folder; titles come from one aggregate of their blocks. What a law's blocks say of
    each other meets the lines by law, and the result stays dealt by law, ``LINES`` to a partition: what follows needs no other shuffle.
    """
    spark = lines.sparkSession
    lines = written(lines, "law-lines", max(1, LINES // 4))
    blocks = lines.groupBy("law_id", "block_no", "block_id", "block_title", "block_type").agg((F.max("version_no") + 1).alias("next"))
    # read twice below: titles are taken apart once, a block's and not each line's, as they would be if a filter on their numbers could go below the aggregate
    blocks = written(blocks.withColumn("numbers", title_numbers(F.col("block_title"))), "law-titles")
    single = blocks.filter("size(numbers) = 1").select("law_id", F.col("numbers")[0].alias("number"), F.struct("block_no", "block_id", "block_title", "block_type", "next").alias("to"))
    compound = blocks.filter("size(numbers) > 1").select("law_id", "block_id", F.explode("numbers").alias("number"))
    n = partitions(spark, lines.count(), LINES)
    moves = compound.join(single, ["law_id", "number"], "left").repartition(n, "law_id").groupBy("law_id").agg(F.collect_list(F.struct(F.col("block_id").alias("of"), "to")).alias("_moves"))
    rows = lines.repartition(n, "law_id").join(moves.hint("shuffle_hash"), "law_id", "left")
    here = F.filter("_moves", lambda m: m["of"] == F.col("block_id"))
    none = F.array(F.lit(None).cast(single.schema["to"].dataType))
    found = F.filter(F.transform(here, lambda m: m["to"]), lambda to: to.isNotNull())
    rows = rows.withColumn("_to", F.explode(F.when(F.size(here) > 0, found).otherwise(none)))
    to, moved = F.col("_to"), F.col("_to").isNotNull()
    text = F.when(moved & (F.col("line_no") == 0), to["block_title"]).otherwise(F.col("text"))
    values = {c: F.when(moved, to[c]).otherwise(F.col(c)) for c in ("block_no", "block_id", "block_title", "block_type")}
    rows = rows.withColumns({**values, "version_no": F.when(moved, F.col("version_no") + to["next"]).otherwise(F.col("version_no")), "text": text})
    return rows.select(*lines.columns)


def graph_rows(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node rows (id, label, name) and edge rows (src, rel, dst) of laws and article versions."""
    laws = versions.select(F.col("law_id").alias("id")).distinct().select("id", F.lit("normativa").alias("label"), F.col("id").alias("name"))
    nodes = laws.unionByName(versions.select(F.col("article_id").alias("id"), F.col("node_type").alias("label"), "name"))
    edge = lambda src, rel, dst: F.struct(F.col(src).alias("src"), F.lit(rel).alias("rel"), F.col(dst).alias("dst"))
    follows = [F.when(F.col("next_id").isNotNull(), e) for e in (edge("article_id", "NEXT_VERSION", "next_id"), edge("next_id", "PREVIOUS_VERSION", "article_id"))]
    # all edges of a version at once: versions are worked out once
    edges = versions.select(F.explode(F.array_compact(F.array(edge("article_id", "PART_OF", "law_id"), *follows))).alias("e")).select("e.*")
    return nodes, edges


def tree_edges(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, node_type, name, place) and edges (src, dst) of whole laws: the law, its headings, articles and what lies in these.

    A heading is a child of the nearest wider heading before it, an article of the nearest heading, an element of the element or article that it belongs
    to. ``place`` orders a law's nodes as its lines are.
    """
    rows = classified(lines).withColumn("place", F.struct("block_no", "version_no", "line_no"))
    order = Window.partitionBy("law_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    heading_id = F.concat_ws("~", "law_id", F.col("block_no").cast("string"), F.col("line_no").cast("string"))
    heads = rows.filter(F.col("node_type").isin(STRUCTURE) | F.col("node_type").isin(ARTICLES))
    for k, name in enumerate(STRUCTURE):
        heads = heads.withColumn(f"_{k}", F.last(F.when(F.col("node_type") == name, F.struct("place", heading_id.alias("id"))), ignorenulls=True).over(order))
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in enumerate(STRUCTURE) for x in reversed(kv)])[F.col("node_type")], F.lit(len(STRUCTURE)))
    # of the wider headings before a line, the last one
    wider = F.array_compact(F.array(*[F.when(rank > k, F.col(f"_{k}")) for k in range(len(STRUCTURE))]))
    up = F.coalesce(F.array_max(wider)["id"], F.col("law_id"))
    article = F.col("node_type").isin(ARTICLES)
    article_id = F.concat_ws("_", "law_id", "block_id", F.col("version_no").cast("string"))
    heads = heads.select(F.when(article, article_id).otherwise(heading_id).alias("src"), up.alias("dst"), "node_type", F.col("text").alias("name"), "place").dropDuplicates(["src"])
    inner = elements(lines).join(rows.select(F.concat_ws("#", article_id, F.col("line_no").cast("string")).alias("element_id"), "place"), "element_id")
    inner = inner.select(F.col("element_id").alias("src"), F.col("parent_id").alias("dst"), "node_type", F.col("text").alias("name"), "place")
    both = heads.unionByName(inner)
    laws = lines.select(F.col("law_id").alias("id")).distinct().select("id", F.lit("normativa").alias("node_type"), F.col("id").alias("name"), F.lit(None).cast(both.schema["place"].dataType).alias("place"))
    return laws.unionByName(both.select(F.col("src").alias("id"), "node_type", "name", "place")), both.select("src", "dst", "place")


def _saved_rows(lines: DataFrame) -> DataFrame:
    """A row for each line as a heading, an article or an element (a heading inside an article is both), with what it is saved by: id, owner, up, node_type,
    name, where it stands (``_at`` its article, ``below`` 1 if it lies in it, then its own place), and kept, whether it is the first of its id.

    Lines are classified once, and one order serves all windows: within a version of a block by line, headings by their block. Other lines stay, not kept,
    so that each law has a row.
    """
    rows = classified(lines).withColumn("_heading", F.explode(F.when(F.col("node_type").isin(STRUCTURE), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    heading, article = F.col("_heading"), F.col("_article")
    rows = rows.withColumns({
        "_article": F.col("node_type").isin(ARTICLES),
        "_rank": F.when(~heading, _rank()),
        # an id's parts: a heading's are its block and line, whatever the version; an article's the block's id and the version
        "_of": F.when(heading, F.col("block_no").cast("string")).otherwise(F.col("block_id")),
        "_version": F.when(~heading, F.col("version_no")),
        "_turn": F.when(heading, F.col("version_no")).otherwise(F.col("block_no")),
    })
    part = ["law_id", "_heading", "_of", "_version"]
    rows = _above(rows, Window.partitionBy(*part).orderBy("line_no", "_article", "_turn"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*part, "line_no", "_article").orderBy("_turn")))
    rows = rows.withColumn("_first", F.min(F.when(article, F.struct("block_no", "version_no", "line_no"))).over(Window.partitionBy(*part)))
    owner = F.concat_ws("_", "law_id", "block_id", F.col("version_no").cast("string"))
    itself = (F.col("_first.block_no") == F.col("block_no")) & (F.col("_first.line_no") == F.col("line_no"))
    line = F.col("line_no").cast("string")
    names = F.when(heading, F.concat_ws("~", "law_id", F.col("block_no").cast("string"), line)).when(article, owner).otherwise(F.concat_ws("#", owner, line))
    parent = F.element_at("_above", -1).cast("string")
    return rows.select(
        "law_id",
        names.alias("id"),
        F.when(heading | article, F.col("law_id")).when(F.size("_above") == 0, owner).otherwise(F.concat_ws("#", owner, parent)).alias("up"),
        "node_type",
        F.col("text").alias("name"),
        ((F.col("_nth") == 1) & (heading | F.when(article, itself).otherwise(F.col("_first").isNotNull()))).alias("kept"),
        *[F.coalesce(F.col("_first")[c], F.col(c)).alias(f"_at_{c}") for c in ("block_no", "version_no", "line_no")],
        F.when(heading | article, 0).otherwise(1).alias("below"),
        *("block_no", "version_no", "line_no"),
    )


def saved_graph(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node rows (id, label, name, seq_id) and edge rows (src, rel, dst) of whole laws as they are saved: headings are left out and what was below them is
    linked to what is above, at last the law; ``seq_id`` numbers a law's nodes in reading order, headings counted.

    The tree is that of ``tree_edges``, read off the lines: a heading's children follow it up to the next that isn't narrower, so headings and articles are
    in order as their lines are, an article's elements come right after it, and all that is above an article are headings and the law.
    """
    rows = _saved_rows(lines)
    saved = F.col("kept") & ~F.col("node_type").isin(STRUCTURE)
    edges = rows.filter(saved).select(F.col("id").alias("src"), F.lit("PART_OF").alias("rel"), F.col("up").alias("dst"))
    # the law itself comes before its first row; only of a law that can't be read that has no block
    place = [F.asc_nulls_last("_at_block_no"), "_at_version_no", "_at_line_no", "below", "block_no", "version_no", "line_no", "id"]
    order = Window.partitionBy("law_id").orderBy(*place)
    seq = F.sum(F.col("kept").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_seq": seq, "_start": F.row_number().over(order) == 1})
    number = lambda n: F.concat_ws("_", "law_id", n.cast("string"))
    law = F.struct(F.col("law_id").alias("id"), F.lit("normativa").alias("label"), F.col("law_id").alias("name"), F.when(F.col("_at_block_no").isNotNull(), number(F.lit(0))).alias("seq_id"))
    own = F.struct("id", F.col("node_type").alias("label"), "name", number(F.col("_seq")).alias("seq_id"))
    rows = rows.filter(saved | F.col("_start")).withColumn("_n", F.explode(F.array_compact(F.array(F.when(F.col("_start"), law), F.when(saved, own)))))
    return rows.select("_n.*"), edges


def saved_counts(lines: DataFrame) -> DataFrame:
    """kind, name, n: nodes of ``saved_graph`` by label and edges by relation, as a save reports them, in one pass: each node but the laws has one edge."""
    rows = _saved_rows(lines).withColumn("_saved", F.col("kept") & ~F.col("node_type").isin(STRUCTURE))
    # a row for each law and label first, where the law lies
    each = rows.groupBy("law_id", "node_type").agg(F.count_if("_saved").alias("n")).groupBy("law_id").agg(F.collect_list(F.struct("node_type", "n")).alias("_n"))
    count = lambda kind, name, n: F.struct(F.lit(kind).alias("kind"), name.alias("name"), n.alias("n"))
    kinds = F.transform("_n", lambda x: count("node", x["node_type"], x["n"]))
    edges = F.transform("_n", lambda x: count("edge", F.lit("PART_OF"), x["n"]))
    each = each.select(F.explode(F.concat(F.array(count("node", F.lit("normativa"), F.lit(1).cast("long"))), kinds, edges)).alias("c")).select("c.*")
    return each.groupBy("kind", "name").agg(F.sum("n").alias("n")).filter("n > 0")


def _rank() -> Column:
    """How wide a line's mark is: a numbered paragraph 1, letters 2, ordinals 3, anything else 4."""
    ranks = {name: 1 + min(k, 2) for k, name in enumerate(ITEMS)}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col("node_type")], F.lit(4))


def _above(rows: DataFrame, order: WindowSpec) -> DataFrame:
    """``rows`` (_rank) with _above: the line numbers of the marks above each, outermost first."""
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    for k in (1, 2, 3):
        rows = rows.withColumn(f"_m{k}", F.last(F.when(F.col("_rank") == k, F.col("line_no")), ignorenulls=True).over(before))
    # a mark of rank 2 counts only after the last of rank 1, and so on
    two = F.when(F.col("_m2") > F.coalesce("_m1", F.lit(-1)), F.col("_m2"))
    three = F.when(F.col("_m3") > F.greatest(F.coalesce("_m1", F.lit(-1)), F.coalesce(two, F.lit(-1))), F.col("_m3"))
    chain = [F.when(F.col("_rank") > 1, F.col("_m1")), F.when(F.col("_rank") > 2, two), F.when(F.col("_rank") > 3, three)]
    return rows.withColumn("_above", F.array_compact(F.array(*chain)))


def elements(lines: DataFrame) -> DataFrame:
    """One row per line below an article: element_id, article_id, parent_id (the element it belongs to, or the article),
    depth (1: directly below the article), law_id, block_no, version_no, line_no, node_type, text.

    A numbered paragraph is above letters, letters above ordinals, and anything without a mark belongs to the last mark
    before it. The line's nearest wider mark is found with windows over the lines of its article's version.
    """
    article = ["law_id", "block_id", "version_no"]
    rows = classified(lines).withColumn("_rank", _rank())
    named = F.max(F.col("node_type").isin(ARTICLES)).over(Window.partitionBy(*article))
    rows = rows.withColumn("_named", named).filter(F.col("_named") & ~F.col("node_type").isin(ARTICLES))
    rows = _above(rows, Window.partitionBy(*article).orderBy("line_no"))
    article_id = F.concat_ws("_", "law_id", "block_id", F.col("version_no").cast("string"))
    rows = rows.withColumn("article_id", article_id)
    parent = F.when(F.size("_above") == 0, F.col("article_id")).otherwise(F.concat_ws("#", "article_id", F.element_at("_above", -1).cast("string")))
    return rows.select(F.concat_ws("#", "article_id", F.col("line_no").cast("string")).alias("element_id"), "article_id", parent.alias("parent_id"), (F.size("_above") + 1).alias("depth"), "law_id", "block_no", "version_no", "line_no", "node_type", "text")


def indented_text(parts: DataFrame, step: str = "  ") -> DataFrame:
    """article_id and rich_text: the lines of ``elements`` in order, each indented by its depth."""
    line = F.concat(F.repeat(F.lit(step), F.col("depth") - 1), F.col("text"))
    rows = parts.groupBy("law_id", "article_id").agg(F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))).alias("_lines"))
    return rows.select("article_id", F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("rich_text"))


def subtree_hashes(parts: DataFrame) -> DataFrame:
    """article_id, path, name, node_type, text and digest of each of ``parts`` (elements), the digest of it and all below it.

    A mark is an element's own, or its place among its kind under its parent; one that repeats there is told apart by its turn. A path has kind and mark
    of all from the top down to the element. An element's parent is the last line before it that is a level higher, so what is below one follows it;
    every element goes to those above it and itself, and a digest is made of what came, in order.
    """
    by = ["law_id", "article_id"]
    order = Window.partitionBy(*by, "parent_id", "node_type").orderBy("line_no")
    mark = F.when(F.col("node_type").isin(*ITEMS), F.regexp_extract("text", r"^(\S+)", 1)).otherwise(F.row_number().over(order).cast("string"))
    rows = parts.withColumn("mark", mark)
    turn = F.row_number().over(Window.partitionBy(*by, "parent_id", "node_type", "mark").orderBy("line_no"))
    rows = rows.withColumn("_turn", turn).withColumn("mark", F.when(F.col("_turn") > 1, F.concat_ws("#", "mark", "_turn")).otherwise(F.col("mark")))
    own = F.struct("line_no", "mark", F.concat_ws("\x1f", "node_type", "mark").alias("step"))
    upto = Window.partitionBy(*by).orderBy("line_no")
    chain = [F.when(F.col("depth") >= d, F.last(F.when(F.col("depth") == d, own), ignorenulls=True).over(upto)) for d in range(1, DEEPEST + 1)]
    rows = rows.withColumn("_chain", F.array_compact(F.array(*chain)))
    path = F.array_join(F.transform("_chain", lambda x: x["step"]), "\x1e")
    # a name has the mark of the element above before it
    name = F.array_join(F.transform(F.slice("_chain", F.greatest(F.size("_chain") - 1, F.lit(1)), 2), lambda x: x["mark"]), " ")
    told = F.sha2(F.concat_ws("\x1f", "node_type", "mark", "text"), 256)
    rows = rows.select(*by, "line_no", "depth", told.alias("_told"), F.struct(path.alias("path"), name.alias("name"), "node_type", "text").alias("_own"), F.explode(F.transform("_chain", lambda x: x["line_no"])).alias("_of"))
    each = F.array_sort(F.collect_list(F.struct("line_no", "depth", "_told")))
    # the element itself is the highest of what came
    digest = F.sha2(F.array_join(F.transform("_each", lambda x: F.concat_ws(" ", (x["depth"] - F.col("_top")).cast("string"), x["_told"])), ","), 256)
    itself = F.first(F.when(F.col("_of") == F.col("line_no"), F.col("_own")), ignorenulls=True)
    rows = rows.groupBy(*by, "_of").agg(itself.alias("_own"), each.alias("_each"), F.min("depth").alias("_top"))
    return rows.select("article_id", "_own.*", digest.alias("digest"))


def compared(parts: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes (old_id, new_id, node_type, name, change) of each article version's elements to the next, and what need not be looked at
    (old_id, new_id, pruned: elements in subtrees of equal digests).

    Elements are matched by kind and mark of themselves and all above them. What is below equal digests has equal digests itself, so each matched pair
    says whether it is pruned.
    """
    rows = subtree_hashes(parts)
    side = lambda mine, old: F.struct(F.col(mine).alias("article_id"), F.lit(old).alias("old"))
    pairs = versions.filter("next_id IS NOT NULL").select(F.col("article_id").alias("old_id"), F.col("next_id").alias("new_id"))
    asked = pairs.select("old_id", "new_id", F.explode(F.array(side("old_id", True), side("new_id", False))).alias("s")).select("old_id", "new_id", "s.*")
    both = rows.join(asked, "article_id").groupBy("old_id", "new_id", "path").agg(F.collect_list(F.struct("old", "node_type", "name", "text", "digest")).alias("_both"))
    both = both.withColumns({"a": F.get("_both", F.lit(0)), "b": F.get("_both", F.lit(1))})
    change = F.when(F.col("b").isNotNull(), F.when(F.col("a.text") != F.col("b.text"), "modified")).when(F.col("a.old"), "removed").otherwise("added")
    changes = both.withColumn("change", change).filter("change IS NOT NULL").select("old_id", "new_id", "a.node_type", "a.name", "change")
    pruned = both.filter("a.digest = b.digest").groupBy("old_id", "new_id").agg(F.count("*").alias("pruned"))
    return changes, pruned


def element_changes(parts: DataFrame, versions: DataFrame) -> DataFrame:
    """old_id, new_id, node_type, name, change: elements of each article version that the next one adds, removes or
    alters. Elements are matched by kind and name (their mark, or for those without one their place among its kind)."""
    return compared(parts, versions)[0]


def change_events(changes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """change_id, target_id, source_id and counts of added, modified and removed elements, one row for each pair of versions; with ``known`` (change_id)
    only of pairs that have none yet, so saving twice adds nothing."""
    counts = [F.count_if(F.col("change") == k).alias(k) for k in ("added", "modified", "removed")]
    rows = changes.groupBy(F.col("old_id").alias("target_id"), F.col("new_id").alias("source_id")).agg(*counts)
    rows = rows.select(change_id(F.col("target_id"), F.col("source_id")).alias("change_id"), "*")
    return rows if known is None else rows.join(known.select("change_id").distinct(), "change_id", "left_anti")


def context_text(versions: DataFrame) -> DataFrame:
    """article_id and context: what an embedding of the article is made from."""
    from lexlake.functions.text import date_in_words

    state = F.when(F.col("valid_to").isNull(), "Vigente").otherwise(F.concat(F.lit("Hasta el "), date_in_words(F.col("valid_to"))))
    parts = [("Documento", F.col("law_id")), ("Contexto", F.nullif(F.col("path"), F.lit(""))), ("Artículo", F.col("name")), ("Estado", state), ("Contenido", F.col("full_text"))]
    return versions.select("article_id", F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in parts]).alias("context"))
