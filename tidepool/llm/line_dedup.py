"""Line dedup with a fixed-depth tree of line templates.

A line's words are its tokens; a token with a digit is a variable field.  The tree has the number of tokens
on its first level and the leading tokens on the next ``depth`` ones; a leaf holds templates.  Lines of one
leaf that agree in at least ``similarity`` of their places are one template, whose other places are variable
fields too.  A template recurs if at least ``min_docs`` documents have it in different surroundings, which
are told in two ways:

* among the lines before it, or among those after it, there are at least ``surroundings`` times as many
  different ones as it has documents;
* lines of templates of ``min_docs`` documents or more that follow one another are a run, judged as one unit
  by what surrounds it: the two lines before the run, or the two after it, if neither is of such a template.
  ``min_docs`` different ones are enough, however many copies of documents hold the line besides: a copy is a
  run from end to end, which nothing surrounds, and in a near copy the lines around a changed one recur.

A line that is copied with its whole document is for other operators to treat; what recurs in ever new
surroundings is boilerplate, in one line or several, and it is dropped from every document.  A run that has a
single line between it and a text's end or the next run looks like a near copy and is left to the first rule.

Lines are told apart by 64-bit fingerprints.  Equal lines of a block are one row before the shuffle by leaf,
so a line that every document has costs a leaf one row for each block.  Counts are two-level aggregates.

Defined cases: null and empty texts have no lines with words; lines without words are kept and recur never.
Repeated rows (equal doc_id and text) count as one document and come out each.  A null doc_id is a document
like others.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, RollingHash, Workspace, _mixed, blocks, texts_of, word_spans, word_units

_FIELD = U64(0xA5A5A5A5A5A5A5A5)
_DIGIT = np.zeros(256, np.int64)
_DIGIT[0x30:0x3A] = 1


class Lines:
    """The lines with words of a block: row, number in the row, first word, words, template and leaf."""

    def __init__(self, data: np.ndarray, at: np.ndarray, depth: int):
        breaks = np.flatnonzero(data == 0x0A)
        inner = np.setdiff1d(at[1:-1], [0])
        edges = np.unique(np.concatenate((np.array([0]), inner, breaks + 1)))
        edges = edges[edges < len(data)]
        starts, ends, _ = word_spans(data, at)
        units = word_units(data, starts, ends) if len(starts) else np.zeros(0, U64)
        digits = np.append(0, np.cumsum(_DIGIT[data]))
        self.units = np.where(digits[ends] > digits[starts], _FIELD, units) if len(starts) else units
        first = np.searchsorted(starts, edges)
        count = np.diff(np.append(first, len(starts)))
        row = np.searchsorted(at, edges, "right") - 1
        before = np.append(0, np.cumsum(data == 0x0A))
        number = before[edges] - before[at[row]]
        own = np.flatnonzero(count > 0)
        self.row, self.number, self.first, self.count = row[own], number[own], first[own], count[own]
        prints = RollingHash(self.units)
        self.line = prints.of(self.first, self.first + self.count)
        head = prints.of(self.first, self.first + np.minimum(self.count, depth))
        self.leaf = _mixed(head + self.count.astype(U64) * U64(0x9E3779B97F4A7C15))

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """The place of each line among those with words of its row, and how many these are."""
        first = np.searchsorted(self.row, self.row, "left")
        return np.arange(len(self.row)) - first, np.searchsorted(self.row, self.row, "right") - first

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """The line before and the line after each, 0 at a text's ends."""
        before, after = np.zeros(len(self.line), U64), np.zeros(len(self.line), U64)
        same = self.row[1:] == self.row[:-1]
        before[1:][same] = self.line[:-1][same]
        after[:-1][same] = self.line[1:][same]
        return before, after


def _pairs(near: np.ndarray, turn: int) -> np.ndarray:
    """A fingerprint of the two lines on one side of each, given the nearest one; of no meaning where there are fewer."""
    return _mixed(near * U64(0x9E3779B97F4A7C15) + np.roll(near, turn))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def placed_lines(docs: DataFrame, depth: int) -> DataFrame:
    """doc, key, number, line, before, after for each line with words, its place among n_lines of them, and the two lines on each side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in blocks(batches):
            lines = Lines(data, at, depth)
            before, after = lines.neighbours()
            doc, key = (pa.array(rows.column(c).to_numpy()[lines.row]) for c in ("doc", "key"))
            place, n_lines = (pa.array(x.astype(np.int32)) for x in lines.places())
            columns = [doc, key, pa.array(lines.number.astype(np.int32)), _signed(lines.line), _signed(before), _signed(after)]
            columns += [place, n_lines, _signed(_pairs(before, 1)), _signed(_pairs(after, -1))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "key", "number", "line", "before", "after", "place", "n_lines", "before_two", "after_two"])

    return docs.mapInArrow(run, "doc long, key long, number int, line long, before long, after long, place int, n_lines int, before_two long, after_two long")


def distinct_lines(docs: DataFrame, depth: int) -> DataFrame:
    """leaf, line and tokens (32 bits each) of each different line of a block that has variable places to find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at in blocks(batches):
            lines = Lines(data, at, depth)
            _, own = np.unique(lines.line, return_index=True)
            own = own[lines.count[own] > depth]
            tokens = (lines.units >> U64(32)).astype("<u4")
            packed = [tokens[a : a + n].tobytes() for a, n in zip(lines.first[own].tolist(), lines.count[own].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([_signed(lines.leaf[own]), _signed(lines.line[own]), pa.array(packed, pa.binary())], ["leaf", "line", "tokens"])

    return docs.mapInArrow(run, "leaf long, line long, tokens binary")


def group_leaf(lines: np.ndarray, tokens: np.ndarray, similarity: float) -> np.ndarray:
    """The template of each line of a leaf: the first line of its group, lines in order of fingerprint.

    A line joins the template with which it agrees in the most fixed places, the first such one, if these are at
    least similarity of all places; places in which it differs become variable.  Of ``wide`` places it agrees with
    such a template in one at least, so only templates that have one of the line's rarest tokens in place are compared.
    """
    n, size = tokens.shape
    least = math.ceil(similarity * size - 1e-9)
    wide = size - least + 1
    name = np.empty_like(lines)
    templates: list[int] = []  # the first line of each
    alive = np.ones(tokens.shape, bool)
    has: dict[tuple[int, int], list[int]] = {}
    for i, own in enumerate(tokens.tolist()):
        lists = [has.get(x, ()) for x in enumerate(own)]
        near = sorted({t for held in sorted(lists, key=len)[:wide] for t in held}) if templates else []
        if near:
            rows = np.array([templates[t] for t in near])
            agree = ((tokens[rows] == tokens[i]) & alive[rows]).sum(axis=1)
            k = int(agree.argmax())
            if agree[k] >= similarity * size:
                alive[rows[k]] &= tokens[rows[k]] == tokens[i]
                name[i] = lines[rows[k]]
                continue
        for x in enumerate(own):
            has.setdefault(x, []).append(len(templates))
        templates.append(i)
        name[i] = lines[i]
    return name


def templates(distinct: DataFrame, similarity: float) -> DataFrame:
    """line and template for lines whose template is another line's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def leaves(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            leaf = table.column("leaf").to_numpy()
            cut = len(leaf) if last else int(np.searchsorted(leaf, leaf[-1], "left"))
            if cut < len(leaf):
                held.extend(table.slice(cut).combine_chunks().to_batches())
            line = table.column("line").to_numpy()
            new = np.append(True, line[1:cut] != line[: max(0, cut - 1)])[:cut]  # in order of leaf and line
            own = np.flatnonzero(new)
            _, first, sizes = np.unique(leaf[own], return_index=True, return_counts=True)
            tokens = table.column("tokens")
            found, named = [], []
            for a, n in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                mine = own[a : a + n]
                held_tokens = np.frombuffer(b"".join(tokens.take(pa.array(mine)).to_pylist()), "<u4").reshape(n, -1)
                name = group_leaf(line[mine], held_tokens, similarity)
                other = name != line[mine]
                found.append(line[mine][other])
                named.append(name[other])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(named))], ["line", "template"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if held[0].column("leaf")[0] != batch.column("leaf")[-1]:  # else one leaf goes on
                    yield from leaves(False)
        if held:
            yield from leaves(True)

    return distinct.repartition("leaf").sortWithinPartitions("leaf", "line").mapInArrow(run, "line long, template long")


def run_surroundings(frequent: DataFrame) -> DataFrame:
    """template, head and tail: the two lines before and after the run of each line, null where a line next to the run is no other text's.

    frequent: the lines of placed_lines whose templates have enough documents, so runs are places without a gap.
    """
    of_text = Window.partitionBy(*_TEXT).orderBy("place")
    so_far, from_here = of_text.rowsBetween(Window.unboundedPreceding, 0), of_text.rowsBetween(0, Window.unboundedFollowing)
    before = F.col("place") - F.coalesce(F.lag("place").over(of_text), F.lit(-1))  # 0 for a repeated row
    after = F.coalesce(F.lead("place").over(of_text), F.col("n_lines")) - F.col("place")
    first, last = before.alias("from_last"), after.alias("to_next")
    edges = frequent.select(*_TEXT, "template", "place", "n_lines", "before_two", "after_two", first, last)
    opens = (F.col("from_last") > 1) | (F.col("place") == 0)
    closes = (F.col("to_next") > 1) | (F.col("place") == F.col("n_lines") - 1)
    head = F.when(opens, F.struct(F.when(F.col("from_last") > 2, F.col("before_two")).alias("of")))
    tail = F.when(closes, F.struct(F.when(F.col("to_next") > 2, F.col("after_two")).alias("of")))
    return edges.select("template", F.last(head, True).over(so_far)["of"].alias("head"), F.first(tail, True).over(from_here)["of"].alias("tail"))


#: What a text is known by: its doc_id, and a fingerprint that tells rows apart that share one.
_TEXT = ("doc", "key")


def _known(doc_id: str, text: str) -> list[Column]:
    nobody = F.lit(-(1 << 63))  # rows without a doc_id are told apart by their text alone
    return [F.coalesce(F.col(doc_id).cast("long"), nobody).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key")]


def recurring_lines(spark: SparkSession, docs: DataFrame, depth: int = 3, similarity: float = 0.8, min_docs: int = 4, surroundings: float = 0.7) -> DataFrame:
    """doc, key and gone (numbers of the lines to drop, from 0) for documents that have any."""
    work = Workspace(spark, "lines")
    keyed = texts_of(docs).select("*", *_known("doc_id", "text"))
    lines = work.write(placed_lines(keyed, depth), "placed")
    named = work.write(templates(distinct_lines(keyed, depth), similarity), "templates")
    # the tree's names for lines: a line without another name is its own template
    of_template = lines.join(named, "line", "left").select(*_TEXT, "number", "before", "after", "place", "n_lines", "before_two", "after_two", F.coalesce("template", "line").alias("template"))
    of_template = work.write(of_template, "named")
    often = work.write(of_template.groupBy("template").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("template"), "often")
    frequent = work.write(of_template.join(often, "template", "left_semi"), "frequent")

    def different(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        pairs = rows.groupBy("template", *columns).agg(F.lit(1).alias("one"))
        return pairs.groupBy("template").agg(F.count(columns[0]).alias(name))

    n_docs = work.write(different(frequent, "n_docs", *_TEXT).filter(F.col("n_docs") >= min_docs), "documents")
    counts = n_docs.join(different(frequent, "n_before", "before"), "template").join(different(frequent, "n_after", "after"), "template")
    apart = counts.filter(F.greatest("n_before", "n_after") >= surroundings * F.col("n_docs")).select("template")
    around = work.write(run_surroundings(frequent.join(n_docs, "template", "left_semi")), "runs")
    n_around = [different(around, "n", c).filter(F.col("n") >= min_docs).select("template") for c in ("head", "tail")]
    recurring = work.write(apart.union(n_around[0]).union(n_around[1]).distinct(), "recurring")
    gone = frequent.join(recurring, "template", "left_semi").groupBy(*_TEXT).agg(F.sort_array(F.collect_set("number")).alias("gone"))
    return work.write(gone, "gone")


def _cut(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """row (all columns of docs), text (kept), n_lines and n_dropped; columns of docs may have any names."""
    split = F.split(F.coalesce("row.text", F.lit("")), "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone")), lambda i: F.get(F.col("parts"), i))
    whole = docs.select(F.struct("*").alias("row")).select("row", *_known("row.doc_id", "row.text"))
    # a merge join at every size: what is gone grows with the documents
    held = whole.join(gone.hint("merge"), list(_TEXT), "left").withColumn("parts", split)
    return held.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size("parts").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )


def drop_lines(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text for each row."""
    return _cut(docs, recurring_lines(spark, docs, **options)).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "text")


def cut_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The documents with their recurring lines cut out and n_chars, if they have it, counted anew; those of which no word is left go."""
    cut = _cut(docs, recurring_lines(spark, docs, **options)).filter((F.col("n_dropped") == 0) | F.col("text").rlike("[^ \\x09-\\x0D]"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") == 0, F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None)).otherwise(F.length("text"))}
    return cut.select(*(new[c].cast(t).alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c, t in docs.dtypes))
