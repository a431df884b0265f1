"""Line dedup: a fixed-depth tree of line templates; lines whose template recurs across documents are dropped.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import cut

#: Stands for a variable field in a template.
ANY = "<*>"
#: Words that hold a digit or an at sign, or look like an address: variable by their form.
VARIABLE = r"(?<!\S)(?=\S*(?:[0-9@]|://))\S+"


#: Lines whose places are looked up together.
BLOCK = 256
#: Rows of a few numbers each that are sent to every task, at most; beyond it both sides of a join are shuffled.
BROADCAST = 1_000_000


def tidied(line: Column, words: Column | None = None) -> Column:
    """The words of a line with one space between; with words, those, which have the line's own space between."""
    spaced = line.startswith(" ") | line.endswith(" ")
    for odd in ("  ", "\t", "\v", "\f", "\r"):
        spaced = spaced | line.contains(odd)
    words = line if words is None else words
    return F.when(spaced, F.btrim(F.regexp_replace(words, r"\s+", " "))).otherwise(words)


def plain(line: Column) -> Column:
    """The words of a line with one space between, and ANY for those that are variable by their form. Regular expressions
    run where plainer tests leave them something to do."""
    return tidied(line, F.when(line.rlike("[0-9@]") | line.contains("://"), F.regexp_replace(line, VARIABLE, ANY)).otherwise(line))


def joined_to(lines: DataFrame, keys: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of lines to the few keys that some have: keys are written out and counted, and sent to the lines up to
    BROADCAST of them, so that a line that many documents share isn't dealt to one task. Beyond it adaptive execution
    splits such a key."""
    keys = cut(keys)
    return lines.join(F.broadcast(keys) if keys.count() <= BROADCAST else keys, on, how)


def parsed(docs: DataFrame, depth: int, *more: str | Column, passage: int | None = None) -> DataFrame:
    """(doc_id, at, leaf, form, ...) of every line that isn't blank: its place, its leaf in the tree, which is its
    number of words and the first ``depth`` of them, and the hash of all its words; with passage also ``own``, two hashes of
    the words as they are, for lines of so many words or more."""
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    if passage:
        # a line of so many words has so many characters at least
        tidy = F.when(F.octet_length("line") >= 2 * passage - 1, tidied(F.col("line")))
        long = F.octet_length("tidy") - F.octet_length(F.replace("tidy", F.lit(" "))) + 1 >= passage
        lines = lines.withColumn("tidy", tidy).withColumn("own", F.when(long, F.struct(F.xxhash64("tidy").alias("one"), F.xxhash64(F.lit("two"), "tidy").alias("two")))).drop("tidy")
        more = (*more, "own")
    # blank lines are told by the text as it is: a test of plain() would have it worked out twice
    lines = lines.where(F.btrim("line", F.lit(" \t\v\f\r")) != "").withColumn("line", plain(F.col("line")))
    count = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1
    return lines.select("doc_id", "at", F.xxhash64(count, F.substring_index("line", " ", depth)).alias("leaf"), F.xxhash64("line").alias("form"), *more)


def repeated(passages: DataFrame) -> DataFrame:
    """(doc_id, at) of those passages (doc_id, at, own) that a document with a smaller doc_id has too."""
    lines = passages.select("doc_id", "at", "own.*")
    copies = lines.select("one", "two", "doc_id").distinct().groupBy("one", "two").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n >= 2").drop("n")
    return joined_to(lines, copies, ["one", "two"]).where("doc_id <> first").select("doc_id", "at")


def recurring_lines(docs: DataFrame, min_docs: int = 8, depth: int = 3, max_children: int = 8, similarity: float = 0.5, passage: int | None = 20) -> DataFrame:
    """(doc_id, at) of the lines that recur in a document with a smaller doc_id: those whose template is in at least
    ``min_docs`` documents, and those of ``passage`` words or more that any other has. See drop_recurring()."""
    lines = cut(parsed(docs, depth, passage=passage))
    # a template is within a leaf, so only leaves in that many documents can have one that recurs
    leaves = lines.select("leaf", "doc_id").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    forms = cut(joined_to(parsed(docs, depth, "line"), leaves, ["leaf"], "left_semi").groupBy("leaf", "form").agg(F.split(F.min("line"), " ").alias("words")))
    # a place in a leaf's lines that takes more words than max_children is variable, but for a word that most lines have there
    places = (
        forms.select("leaf", F.posexplode("words").alias("place", "word"))
        .where(F.col("place") >= depth)
        .groupBy("leaf", "place", "word")
        .agg(F.count("*").alias("n"))
        .groupBy("leaf", "place")
        .agg(F.count("*").alias("n"), F.sum("n").alias("all"), F.max(F.struct("n", "word")).alias("top"))
        .where(F.col("n") > max_children)
        .groupBy("leaf")
        .agg(F.map_from_entries(F.collect_list(F.struct("place", F.when(2 * F.col("top.n") > F.col("all"), F.col("top.word")).otherwise("")))).alias("open"))
    )
    closed = F.transform("words", lambda word, place: F.when(F.element_at("open", place) != word, ANY).otherwise(word))
    fixed = F.size(F.filter("closed", lambda word: word != ANY))
    # the leading words are alike in all of a leaf: only those after them tell that lines with opened places are of one template
    after = F.size(F.filter("closed", lambda word, place: (place >= depth) & (word != ANY)))
    alike = (F.col("closed") == F.col("words")) | (2 * after > F.size("words") - depth)
    templates = (
        forms.join(places, "leaf", "left")
        .withColumn("closed", F.when(F.col("open").isNull(), F.col("words")).otherwise(closed))
        .select("leaf", "form", F.when((fixed >= similarity * F.size("words")) & alike, F.xxhash64("closed")).otherwise(F.col("form")).alias("template"), (fixed > 0).alias("says"))
        .where("says")
        .drop("says")
    )
    found = cut(joined_to(lines, templates, ["leaf", "form"]).select("doc_id", "at", "leaf", "template"))
    spread = found.select("leaf", "template", "doc_id").distinct().groupBy("leaf", "template").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    gone = joined_to(found, spread.where(F.col("n") >= min_docs), ["leaf", "template"]).where("doc_id <> first").select("doc_id", "at")
    return gone.union(repeated(lines.where("own is not null"))) if passage else gone


def by_blocks(places: DataFrame, name: str) -> DataFrame:
    """(doc_id, n, name) from (doc_id, at): how many places a document has, and an array that has for each BLOCK lines
    the places among them, so that looking one up doesn't take longer the more there are."""
    blocks = places.groupBy("doc_id", F.floor(F.col("at") / BLOCK).cast("int").alias("block")).agg(F.collect_set("at").alias("ats"))
    whole = blocks.groupBy("doc_id").agg(F.sum(F.size("ats")).alias("n"), F.max("block").alias("most"), F.map_from_entries(F.collect_list(F.struct("block", "ats"))).alias("by"))
    return whole.select("doc_id", "n", F.transform(F.sequence(F.lit(0), "most"), lambda k: F.element_at("by", k)).alias(name))


def without(text: str, gone: str) -> Column:
    """The text without the lines at the places that by_blocks() has."""
    stays = F.filter(F.split(text, "\n", -1), lambda line, at: ~F.coalesce(F.array_contains(F.get(gone, F.floor(at / BLOCK).cast("int")), at), F.lit(False)))
    return F.array_join(stays, "\n")


def deduplicated(docs: DataFrame, **settings: float) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for every row: the text that drop_recurring() leaves, and its line counts.
    A null text has no lines and stays null."""
    gone = by_blocks(recurring_lines(docs, **settings), "gone")
    lines = F.split("text", "\n", -1)
    return docs.select("doc_id", "text").join(gone, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(without("text", "gone")).alias("text"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.col("n")), F.lit(0)).cast("long").alias("n_dropped"),
    )


def drop_recurring(docs: DataFrame, **settings: float) -> DataFrame:
    """The rows of docs with the lines gone whose template recurs across documents; columns and other text as they were.

    A line's template is its words, with ANY for words with digits, addresses, and places where lines of its leaf
    (as many words, the same first ``depth``) have over ``max_children`` different words, but for a word that over half
    of the leaf's different lines have there; if under the share ``similarity`` of its words stays fixed, or not over
    half of those after the first ``depth``, only the former. So lines that have but their beginning in common stay,
    however many fill a leaf. A template in at least ``min_docs`` documents recurs;
    its lines stay in the document with the smallest doc_id alone, so that no text is lost as a whole. A line of
    ``passage`` words or more recurs from two documents on, if its words are the same (digits too, whatever the space
    between); None leaves such lines to the templates, for tables whose near copies are dropped later, and would be emptied.

    Blank lines, lines of variable words only, and rows with a null doc_id or text stay as they are. Rows that
    repeat a doc_id count as one document and lose lines at the same places. n_chars, where there is one, isn't
    counted anew. An empty table gives no rows.

    Hashes, not texts, are shuffled for the counts, with a document counted once before; each text is shuffled once.
    """
    gone = next(f"gone{k}" for k in range(len(docs.columns) + 1) if f"gone{k}" not in docs.columns)
    places = by_blocks(recurring_lines(docs, **settings), gone).drop("n")
    return docs.join(places, "doc_id", "left").withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(without("text", gone))).select(docs.columns)


def drop_passages(docs: DataFrame, least: int = 20) -> DataFrame:
    """The rows of docs without the lines of ``least`` words or more that a document with a smaller doc_id has too, with
    the same words (digits too, whatever the space between); columns and other text as they were.

    It takes two documents, where drop_recurring() takes more; so near copies should have left before, else a copy is
    emptied rather than dropped. Rows with a null doc_id or text stay as they are; rows that repeat a doc_id count as
    one document. Hashes of long lines alone are shuffled for the counts; each text is shuffled once.
    """
    gone = next(f"gone{k}" for k in range(len(docs.columns) + 1) if f"gone{k}" not in docs.columns)
    lines = cut(parsed(docs, 1, passage=least).where("own is not null").select("doc_id", "at", "own"))
    places = by_blocks(repeated(lines), gone).drop("n")
    return docs.join(places, "doc_id", "left").withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(without("text", gone))).select(docs.columns)
