"""Operators over extracted rows, in built-in DataFrame operations.

Each states how it treats order; ties are always broken by an explicit column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import glob_to_regex, strip


@dataclass(frozen=True)
class FileFilter:
    """All bounds are half-open; a NULL date fails where a bound is set. Suffixes are compared
    without case, path patterns are shell patterns over the whole path."""

    created_after: str | None = None
    created_before: str | None = None
    modified_after: str | None = None
    modified_before: str | None = None
    extensions: Sequence[str] = ()
    path_patterns: Sequence[str] = ()
    folder_paths: Sequence[str] = field(default=())

    def column(self, created: Column, modified: Column, path: Column) -> Column:
        tests = []
        for value, after, before in ((created, self.created_after, self.created_before), (modified, self.modified_after, self.modified_before)):
            if after:
                tests.append(value >= F.lit(after).cast("timestamp"))
            if before:
                tests.append(value < F.lit(before).cast("timestamp"))
        if self.extensions:
            tests.append(reduce(Column.__or__, [F.lower(path).endswith(e.lower()) for e in self.extensions]))
        if self.path_patterns:
            tests.append(reduce(Column.__or__, [path.rlike(glob_to_regex(p)) for p in self.path_patterns]))
        return F.coalesce(reduce(Column.__and__, tests, F.lit(True)), F.lit(False))

    def apply(self, files: DataFrame, created: str = "created", modified: str = "last_modified", path: str = "full_path") -> DataFrame:
        return files.where(self.column(F.col(created), F.col(modified), F.col(path)))


def joined_text(rows: DataFrame, keys: list[str], order: str, text: str, out: str = "full_text", separator: str = "\n") -> DataFrame:
    """The texts of a group in order, joined and stripped."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text))))
    return rows.groupBy(*keys).agg(strip(F.array_join(F.transform(ordered, lambda r: r[text]), separator)).alias(out))


def numbered(rows: DataFrame, keys: list[str], order: list[str], out: str = "unit_number") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_of_content(rows: DataFrame, content: Column, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """The first row of every SHA-1 of content: the columns named by keep (all if None) and its
    digest. The digest is what is grouped by, so of the content itself nothing moves unless kept."""
    names = keep if keep is not None else rows.columns
    marked = rows.select(*names, F.struct(*order).alias("__order"), F.sha1(content).alias("digest"))
    return marked.groupBy("digest").agg(F.min_by(F.struct(*names), "__order").alias("__row")).select("__row.*", "digest")


def diverse_enough(rows: DataFrame, group: list[str], measure: str, trivial: int = 8, share: float = 0.6) -> DataFrame:
    """Of a group those with at least `share` of its greatest measure; groups of one, and those
    whose greatest is at most `trivial`, whole."""
    names = rows.columns
    best = rows.groupBy(*group).agg(F.max(measure).alias("__most"), F.count("*").alias("__n"))
    kept = rows.join(best.select(*[F.col(g).alias(f"__g_{g}") for g in group], "__most", "__n"), reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group]))
    return kept.where((F.col("__n") == 1) | (F.col("__most") <= trivial) | (F.col(measure) >= share * F.col("__most"))).select(*names)


def dealt(rows: DataFrame, order: list[str], hands: int, keys: list[str], out: str = "hand") -> DataFrame:
    """Rows of a group dealt in turn to hands 1 to `hands`."""
    return rows.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) % hands + 1)


def following(rows: DataFrame, keys: list[str], order: list[str], value: Column, out: str, inclusive: bool = True) -> DataFrame:
    """The first value that isn't NULL from a row on (or after it)."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0 if inclusive else 1, Window.unboundedFollowing)
    return rows.withColumn(out, F.first(value, ignorenulls=True).over(frame))


def page_of_position(rows: DataFrame, keys: list[str], order: list[str], is_break: Column, out: str = "page") -> DataFrame:
    """1 and the number of breaks before a row."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum(is_break.cast("long")).over(frame), F.lit(0)) + 1)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line) of every line, from 0."""
    return docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))


def equal_runs(rows: DataFrame, keys: list[str], order: str, value: str, least: int = 2) -> DataFrame:
    """Runs of rows with equal value: (keys, run, value, rows, first, last), from `least` rows on."""
    by = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("__new", F.when(F.col(value).eqNullSafe(F.lag(value).over(by)) & F.lag(F.lit(1)).over(by).isNotNull(), 0).otherwise(1))
    islands = marked.withColumn("run", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "run", value).agg(F.count("*").alias("n_rows"), F.min(order).alias("first_row"), F.max(order).alias("last_row")).where(F.col("n_rows") >= least)


def sections(rows: DataFrame, keys: list[str], order: str, is_heading: Column, heading: Column) -> DataFrame:
    """Rows with their section's number (0 before the first heading) and heading."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.sum(is_heading.cast("long")).over(upto)).withColumn("heading", F.last(F.when(is_heading, heading), ignorenulls=True).over(upto))


def inline_tables(lines: DataFrame, id_col: str) -> DataFrame:
    """Lines of an even number of tokens, four at least, words first and then as many numbers:
    (id, line_no, header, values)."""
    tokens = lines.withColumn("__t", F.filter(F.split(F.col("line"), r"\s+"), lambda t: t != ""))
    half = (F.size("__t") / 2).cast("int")
    found = tokens.where((F.size("__t") >= 4) & (F.size("__t") % 2 == 0)).withColumn("header", F.slice("__t", 1, half)).withColumn("values", F.slice("__t", half + 1, half))
    return found.where(F.forall("header", lambda t: t.rlike("^[A-Za-z]+$")) & F.forall("values", lambda t: t.rlike("^[0-9]+$"))).select(id_col, "line_no", "header", "values")


#: Needles that are searched for together, by their number and their characters.
NEEDLES, NEEDLE_CHARS = 50_000, 16 << 20


def contains_match(left: DataFrame, left_id: str, left_text: str, right: DataFrame, right_id: str, needle: str, fallback: int | None = None) -> DataFrame:
    """For every right row the least left id whose text contains its needle, else the fallback.

    Every text is read once for all needles of a block, by one automaton. Blocks are made so that
    an automaton fits in memory: one pass for NEEDLES needles or NEEDLE_CHARS characters. A NULL
    needle is in no text, an empty one in all that aren't NULL."""
    words = right.select(F.col(needle).cast("string").alias("needle")).where("needle IS NOT NULL").distinct()
    size = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("needle")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size.n // NEEDLES), -(-size.chars // NEEDLE_CHARS))
    texts = left.select(F.col(left_id).alias("__left"), F.col(left_text).cast("string").alias("__text")).where("__text IS NOT NULL AND __left IS NOT NULL")
    kind = texts.schema[0].dataType.simpleString()
    hits = texts.agg(F.lit("").alias("needle"), F.min("__left").alias("__left")).where("__left IS NOT NULL")
    for block in range(blocks):
        held = [r.needle for r in words.where((F.pmod(F.xxhash64("needle"), F.lit(blocks)) == block) & (F.col("needle") != "")).collect()]
        shared = left.sparkSession.sparkContext.broadcast(held)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, word in enumerate(shared.value):
                automaton.add_word(word, i)
            if not len(automaton):
                return
            automaton.make_automaton()
            for batch in batches:
                rows, found = [], []
                for row, text in enumerate(batch.column(1)):
                    here = {i for _, i in automaton.iter(text.as_py())}
                    rows += [row] * len(here)
                    found += here
                yield pa.RecordBatch.from_arrays([pa.array([shared.value[i] for i in found], pa.string()), batch.column(0).take(pa.array(rows, pa.int64()))], names=["needle", "__left"])

        hits = hits.unionByName(texts.mapInArrow(search, f"needle string, __left {kind}"))
    first = hits.groupBy("needle").agg(F.min("__left").alias("__found"))
    wanted = right.select(F.col(right_id), F.col(needle).cast("string").alias("needle"))
    return wanted.join(first, "needle", "left").select(right_id, F.coalesce("__found", F.lit(fallback).cast(kind)).alias(left_id))


def right_justified(rows: DataFrame, columns: list[str], out: str = "line", separator: str = " ") -> DataFrame:
    """Columns padded on the left to their greatest length and joined. The widths are one row."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    widths = rows.agg(*[F.max(F.length(s)).alias(f"__w{i}") for i, s in enumerate(shown)])
    padded = [F.when(F.length(s) < F.col(f"__w{i}"), F.lpad(s, F.col(f"__w{i}"), F.lit(" "))).otherwise(s) for i, s in enumerate(shown)]
    return rows.crossJoin(F.broadcast(widths)).withColumn(out, F.concat_ws(separator, *padded)).drop(*[f"__w{i}" for i in range(len(columns))])


def bag_union(rows: DataFrame, folder: Column, folders: Sequence[str]) -> DataFrame:
    """A listing of several folders; a row comes once for every folder that holds it."""
    wanted = [rows.where((folder == f) | folder.startswith(f + "/")) for f in folders]
    return reduce(DataFrame.unionAll, wanted) if wanted else rows.limit(0)


def median_gap(rows: DataFrame, keys: list[str], order: str, at: Column) -> DataFrame:
    """The median distance of neighbours of a group."""
    by = Window.partitionBy(*keys).orderBy(order)
    gaps = rows.withColumn("__at", at).withColumn("__gap", F.col("__at") - F.lag("__at").over(by))
    return gaps.groupBy(*keys).agg(F.median("__gap").alias("median_gap"), F.count("__gap").alias("gaps"))


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) of runs of Latin letters, without case."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("([a-z]+)"), 1)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def nested_paths(nodes: DataFrame, node_id: str, parent_id: str, name: str, depth: int | None = None) -> DataFrame:
    """(node, path, depth) of every node under the roots (NULL parent), one join a level, down to
    the deepest. A node that is reached again (by a cycle) is an error; with depth, that many
    levels are looked at and no more."""
    edges = nodes.where(F.col(parent_id).isNotNull()).select(F.col(node_id).alias("__n"), F.col(parent_id).alias("node"), F.col(name).alias("__name"))
    level = nodes.where(F.col(parent_id).isNull()).select(F.col(node_id).alias("node"), F.col(name).alias("path"), F.lit(0).alias("depth"))
    found, d = level, 0
    most = nodes.count() if depth is None else depth
    while d < most:
        d += 1
        level = edges.join(level, "node").select(F.col("__n").alias("node"), F.concat_ws("/", "path", "__name").alias("path"), F.lit(d).alias("depth")).persist()
        if level.isEmpty():
            break
        found = found.unionAll(level)
    return found


def table_scores(rows: DataFrame, keys: list[str], filled: str) -> DataFrame:
    """Score of the tables of a group: 2 for a row with two cells filled, -1 for one with one,
    and -2 for being a table."""
    points = F.when(F.col(filled) >= 2, 2).when(F.col(filled) == 1, -1).otherwise(0)
    return rows.groupBy(*keys).agg((F.sum(points) - 2).alias("score"))


def distinct_in_order(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, values): different values by their first place. Values are folded to their first
    places before they are sorted, so a group's array has one entry a value."""
    firsts = rows.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("__first"))
    ordered = F.array_sort(F.collect_list(F.struct("__first", value)))
    return firsts.groupBy(*keys).agg(F.transform(ordered, lambda r: r[value]).alias("values"))


# Lookups, assignments and choices


def looked_up(rows: DataFrame, key: str, names: DataFrame, name_key: str, name: str, default: str, out: str) -> DataFrame:
    """rows with the name that their key has, else the column default."""
    known = names.select(F.col(name_key).alias("__k"), F.col(name).alias("__v"))
    return rows.join(known, F.col(key) == F.col("__k"), "left").withColumn(out, F.coalesce("__v", F.col(default))).drop("__k", "__v")


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those done; rows with a NULL key stay."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def within_ranges(holders: DataFrame, things: DataFrame, keys: list[tuple[str, str]], low: Column, high: Column, at: Column) -> DataFrame:
    """Every holder with the things of its key whose position lies in its range, both ends included;
    a holder without any comes once, with NULLs. The key makes this an equi-join."""
    same = reduce(Column.__and__, [F.col(a) == F.col(b) for a, b in keys])
    return holders.join(things, same & at.between(low, high), "left")


def neighbour_caption(rows: DataFrame, keys: list[str], order: list[str], text: Column, is_caption: Column, out: str = "caption") -> DataFrame:
    """The text before a row if that is a caption, else the text after it. is_caption is a test of
    the same row's columns."""
    by = Window.partitionBy(*keys).orderBy(*order)
    before, after, fits = F.lag(text).over(by), F.lead(text).over(by), F.lag(is_caption).over(by)
    return rows.withColumn(out, F.when(fits, before).otherwise(after))


def first_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every group, by one aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def better_of(first: Column, second: Column, first_score: Column, second_score: Column) -> Column:
    """The second only where its score is strictly greater."""
    return F.when(second_score > first_score, second).otherwise(first)


def key_union(*columns: DataFrame) -> DataFrame:
    """The distinct values of one-column tables, as `key`."""
    return reduce(DataFrame.unionAll, [c.toDF("key") for c in columns]).distinct()


def by_position(rows: DataFrame, keys: list[str], order: list[Column | str], out: str = "place") -> DataFrame:
    """Places of shapes in reading order."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def data_box(rows: DataFrame, keys: list[str], row: str, cells: Column, filled: Column) -> DataFrame:
    """(keys, last_row, columns): the last row of a sheet that has something, and its widest."""
    return rows.groupBy(*keys).agg(F.max(F.when(filled, F.col(row))).alias("last_row"), F.max(F.when(filled, cells)).alias("columns"))


def heading_paths(rows: DataFrame, keys: list[str], order: str, level: str, text: str, deepest: int = 9, out: str = "heading_path") -> DataFrame:
    """rows with the headings that are open at each, outermost first: a heading of level n closes
    those of level n and deeper. level is NULL for what is no heading; a heading is on its own path."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col(level) == n, F.struct(F.col(order).alias("at"), F.col(text).alias("text"))), ignorenulls=True).over(upto) for n in range(1, deepest + 1)]
    held = rows
    for n, column in enumerate(last, 1):
        held = held.withColumn(f"__l{n}", column)
    open_ = []
    for n in range(1, deepest + 1):
        mine = F.col(f"__l{n}")
        above = [F.col(f"__l{m}") for m in range(1, n)]
        stays = reduce(Column.__and__, [a.isNull() | (a["at"] < mine["at"]) for a in above], mine.isNotNull())
        open_.append(F.when(stays, mine["text"]))
    return held.withColumn(out, F.filter(F.array(*open_), lambda t: t.isNotNull())).drop(*[f"__l{n}" for n in range(1, deepest + 1)])


def assigned_units(things: DataFrame, units: DataFrame, keys: list[str], thing: str, tokens: Column, unit: str, text: str, level: str) -> DataFrame:
    """(keys, thing, unit): the first unit of the thing's document whose text contains all its tokens
    (an array; a caption is an array of one); else the last unit of level 1, else the last one."""
    ends = units.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(level) == 1, F.col(unit))), F.max(unit)).alias("__else"))
    asked = things.select(*keys, thing, tokens.alias("__tokens"))
    contains = (F.size("__tokens") > 0) & F.forall("__tokens", lambda t: F.col("__text").contains(t))
    hits = asked.join(units.select(*keys, F.col(unit).alias("__unit"), F.col(text).alias("__text")), keys).where(contains).groupBy(*keys, thing).agg(F.min("__unit").alias("__first"))
    return asked.join(hits, [*keys, thing], "left").join(ends, keys, "left").select(*keys, thing, F.coalesce("__first", "__else").alias(unit))
