"""Alignment of ground-truth entries with model entries page by page, and error rates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import similarity as M
from lexloom.functions import text as T
from lexloom.sources.scratch import written

# Rows on both sides of the window, and thresholds of headword, second key and fallback.
WINDOW, HEAD, SECOND, FALLBACK = 10, 30, 30, 85
#: Rows of a page in a bucket of the band join, and of scoring, where a window is cut out of its bucket.
BUCKET, WIDE_BUCKET = 32, 256


def band_candidates(truth: DataFrame, model: DataFrame, page: str = "page", seq: str = "seq", window: int = WINDOW) -> DataFrame:
    """Pairs of one page at most `window` rows apart: page, bucket, gt_seq, llm_seq, dist and both rows as structs.

    An equi-join on page and a bucket of BUCKET rows, each model row standing in the one or two buckets that
    its window touches: work grows with rows times the window, not with pages squared. All pairs of a
    ground-truth row have one bucket.
    """
    width = max(BUCKET, 2 * window)
    g = truth.select(F.col(page).alias("page"), F.col(seq).alias("gt_seq"), F.struct(*[c for c in truth.columns if c not in (page, seq)]).alias("gt"), F.floor(F.col(seq) / width).alias("bucket"))
    m = model.select(F.col(page).alias("page"), F.col(seq).alias("llm_seq"), F.struct(*[c for c in model.columns if c not in (page, seq)]).alias("llm"), F.explode(F.array_distinct(F.array(*[F.floor((F.col(seq) + i) / width) for i in (-window, window)]))).alias("bucket"))
    return g.join(m, ["page", "bucket"]).withColumn("dist", F.abs(F.col("gt_seq") - F.col("llm_seq"))).filter(F.col("dist") <= window)


def score_pair(k: str, mk: str, s: str, ms: str, my: str, dist: int, head, second, part) -> tuple[float, str] | None:
    """Score and kind of a candidate by its normalised keys, second keys and synonyms, or None without match.

    The second keys, the long ones, are only compared where the headwords allow a match.
    """
    both = bool(s and ms)
    if mk == k or (h := head(k, mk)) >= HEAD:
        value = second(s, ms) if both else 0
        if value >= SECOND if both else not s and not ms:
            return (300.0 - dist, "primary_exact") if mk == k else (h + (value or h) - dist * 0.1, "primary_fuzzy")
    elif both and (f := max(part(k, mk), part(k, my) if my else 0)) >= FALLBACK and (value := second(s, ms)) >= SECOND:
        return 100.0 + value + f - dist * 0.2, "fallback"
    return None


KEYS = ["gt_key", "llm_key", "gt_second", "llm_second", "llm_synonyms"]


def match_score(pairs: DataFrame, head_ratio=M.plain_ratio, second_ratio=M.plain_token_set_ratio, part_ratio=M.plain_partial_ratio) -> DataFrame:
    """score and kind (primary_exact, primary_fuzzy, fallback) instead of the keys; pairs without match go.

    Candidates have gt_key, llm_key, gt_second, llm_second, llm_synonyms (normalised), dist.
    """
    stay = [c for c in pairs.columns if c not in KEYS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[tuple[str, str], float] = {}

        def known_head(a: str, b: str) -> float:
            if (a, b) not in heads:
                if len(heads) >= 100_000:
                    heads.clear()
                heads[a, b] = head_ratio(a, b)
            return heads[a, b]

        for batch in batches:
            got = [score_pair(*row, known_head, second_ratio, part_ratio) if row[0] else None for row in zip(*(batch.column(c).to_pylist() for c in [*KEYS, "dist"]), strict=True)]
            at = [i for i, x in enumerate(got) if x]
            rest = batch.select(stay).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([float(got[i][0]) for i in at], pa.float64()), pa.array([got[i][1] for i in at], pa.string())], names=[*stay, "score", "kind"])

    kinds = dict(pairs.dtypes)
    return pairs.select(*stay, *KEYS).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in stay), "score double", "kind string"]))


def best_match(scored: DataFrame) -> DataFrame:
    """page, gt_seq, llm_seq, dist, kind, score of the best candidate of each ground-truth row: score, then distance, then primary before fallback, then the first.

    A minimum, so neither sorted nor, with all candidates of a row in one bucket, shuffled.
    """
    order = F.struct((-F.col("score")).alias("worse"), "dist", (F.col("kind") == "fallback").alias("back"), "llm_seq", "kind", "score")
    best = scored.groupBy(*[c for c in ("page", "bucket") if c in scored.columns], "gt_seq").agg(F.min(order).alias("b"))
    return best.select("page", "gt_seq", "b.llm_seq", "b.dist", "b.kind", "b.score")


def keyed(rows: DataFrame, key: str, second: str | None, synonyms: str | None = None) -> DataFrame:
    """page, seq and the normalised key, second and synonyms: what candidates are scored by. Without a second key there is no second check."""
    norm = lambda c: T.normalize_string(T.null_to_empty(F.col(c))) if c else F.lit("")
    return rows.select("page", "seq", norm(key).alias("key"), norm(second).alias("second"), norm(synonyms).alias("synonyms"))


_NAMES = {"gt_key": "gt.key", "llm_key": "llm.key", "gt_second": "gt.second", "llm_second": "llm.second", "llm_synonyms": "llm.synonyms"}


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.select("page", "bucket", "gt_seq", "llm_seq", "dist", *[F.col(v).alias(k) for k, v in _NAMES.items()])


def keyed_candidates(truth: DataFrame, model: DataFrame, key: str, second: str | None, synonyms: str | None = None, window: int = WINDOW) -> DataFrame:
    """band_candidates of rows that were normalised before they met."""
    return _named(band_candidates(keyed(truth, key, second), keyed(model, key, second, synonyms), window=window))


#: Rows, or bytes, of groups that are scored together.
TOGETHER_ROWS, TOGETHER_BYTES = 20_000, 16 << 20
ROW = "page, bucket, side, seq, key, second, synonyms"
FOUND = "gt_seq long, llm_seq long, dist long, kind string, score double"
#: Lengths and edit distance of the keys and second keys of a match.
ERRORS = ["key_truth", "key_model", "key_distance", "second_truth", "second_model", "second_distance"]


def _half_keyed(rows: DataFrame, key: str, second: str | None, synonyms: str | None) -> DataFrame:
    """keyed but for ASCII texts, which M.normalized makes the same of where equal ones are one already."""
    text = lambda c: T.null_to_empty(F.col(c)) if c else F.lit("")
    half = lambda c: F.when(F.octet_length(text(c)) == F.length(text(c)), text(c)).otherwise(T.normalize_string(text(c)))
    return rows.select("page", "seq", half(key).alias("key"), half(second).alias("second"), half(synonyms).alias("synonyms"))


def _both_sides(truth: DataFrame, model: DataFrame, key: str, second: str | None, synonyms: str | None, buckets: Callable) -> DataFrame:
    """Rows of both sides (side 0 and 1) in one exchange by page and bucket, sorted: each text is moved once, but for a model row at a bucket's edge."""
    g, m = (_half_keyed(*x).withColumn("side", F.lit(i)) for i, x in enumerate(((truth, key, second, None), (model, key, second, synonyms))))
    rows = g.withColumn("bucket", buckets(0)).unionByName(m.withColumn("bucket", F.explode(buckets(1))))
    return rows.selectExpr(*ROW.split(", ")).repartition("page", "bucket").sortWithinPartitions("page", "bucket", "side", "seq")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (page and bucket) of sorted rows, with the number of each row's group; a group may span batches."""
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def groups(table: pa.Table) -> np.ndarray:
        page, bucket = (pc.fill_null(pc.dictionary_encode(table.column(c).combine_chunks()).indices, -1).to_numpy(zero_copy_only=False) for c in ("page", "bucket"))
        return np.cumsum(np.concatenate(([0], (np.diff(page) != 0) | (np.diff(bucket) != 0))))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if (rows < TOGETHER_ROWS and size < TOGETHER_BYTES) or all(batch.column(c)[-1].as_py() == held[0].column(c)[0].as_py() for c in (0, 1)):
            continue  # few rows, or one group so far
        table = pa.Table.from_batches(held).combine_chunks()
        number = groups(table)
        end = int(np.searchsorted(number, number[-1]))
        held = table.slice(end).combine_chunks().to_batches()
        rows, size = len(table) - end, sum(x.nbytes for x in held)
        yield table.slice(0, end).combine_chunks(), number[:end]
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, groups(table)


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place as often as it has numbers from low to before high, and these numbers."""
    n = (high - low).clip(0)
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)


class _Scores:
    """Scores of pairs of rows of a table: equal texts are one, and so are equal pairs of texts.

    Pairs that can't be best by a bound aren't compared: equal keys give 300 less the distance, keys that are alike their
    similarity and at most that of the second keys by their bound, and all others 300 less a fifth of the distance.
    """

    def __init__(self, table: pa.Table, head: Callable, second: Callable, part: Callable):
        self.head, self.second, self.bound, self.part, self.part_bound, self.one = M.many(head), M.many(second), M.bounds(second), M.many(part), M.bounds(part), part is head
        self.texts, codes = [], []
        for c in ("key", "second", "synonyms"):
            raw, known = pc.dictionary_encode(table.column(c).combine_chunks()), {}
            code = np.array([known.setdefault(M.normalized(t), len(known)) for t in raw.dictionary.to_pylist()], np.int64)
            codes.append(code[raw.indices.to_numpy(zero_copy_only=False)])
            self.texts.append(list(known))
        self.key, self.two, self.synonyms = codes
        self.empty = [np.array([not t for t in texts], bool) for texts in self.texts]

    def each(self, f: Callable, kinds: tuple[int, int], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """f of pairs of texts by their codes, once for equal pairs."""
        if not len(left):
            return np.zeros(0)
        one, two = (self.texts[k] for k in kinds)
        codes, back = np.unique(left * len(two) + right, return_inverse=True)
        return np.asarray(f([one[c] for c in (codes // len(two)).tolist()], [two[c] for c in (codes % len(two)).tolist()]), float)[back]

    def held(self, kinds: tuple[int, int], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Partial similarities, exact from FALLBACK on."""
        out = self.each(self.part_bound, kinds, left, right)
        at = np.flatnonzero(out >= FALLBACK)
        out[at] = self.each(self.part, kinds, left[at], right[at])
        return out

    def run(self, gi: np.ndarray, mi: np.ndarray, dist: np.ndarray, row: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that match, their scores and kinds (0 exact, 1 fuzzy, 2 fallback). row: number of the row whose best pair is wanted; None wants all."""
        k, mk, s, ms = self.key[gi], self.key[mi], self.two[gi], self.two[mi]
        same = k == mk
        h = np.full(len(gi), 100.0)
        h[~same] = self.each(self.head, (0, 0), k[~same], mk[~same])
        first, no_s, no_ms = same | (h >= HEAD), self.empty[1][s], self.empty[1][ms]
        kind = np.where(same, 0, np.where(first, 1, 2))

        def score(at, value, part):
            return np.where(kind[at] == 0, 300.0 - dist[at], np.where(kind[at] == 1, h[at] + np.where(value > 0, value, h[at]) - dist[at] * 0.1, 100.0 + value + part - dist[at] * 0.2))

        none = np.zeros(len(gi))
        found = np.flatnonzero(first & no_s & no_ms)
        got = score(found, none[found], none[found])
        open_ = np.flatnonzero(~no_s & ~no_ms)
        best = np.full(0 if row is None else int(row.max(initial=-1)) + 1, -np.inf)

        def parts(at):
            """How far the keys, or key and synonyms, hold each other: of pairs whose keys aren't alike."""
            out = np.full(len(at), 100.0)
            low = np.flatnonzero(kind[at] == 2)
            out[low] = h[at[low]] if self.one else self.held((0, 0), k[at[low]], mk[at[low]])
            named = low[~self.empty[2][self.synonyms[mi[at[low]]]]]
            out[named] = np.maximum(out[named], self.held((0, 2), k[at[named]], self.synonyms[mi[at[named]]]))
            return out

        def take(at, part):
            nonlocal found, got
            value = self.each(self.second, (1, 1), s[at], ms[at])
            good = value >= SECOND
            at, now = at[good], score(at[good], value[good], part[good])
            if row is not None:
                np.maximum.at(best, row[at], now)
            found, got = np.concatenate((found, at)), np.concatenate((got, now))

        if row is None:
            rest = open_
        else:
            np.maximum.at(best, row[found], got)
            alike = (s[open_] == ms[open_]) & (kind[open_] < 2)
            take(open_[alike], none[open_[alike]])
            rest = open_[~alike]
            rest = rest[score(rest, none[rest] + 100, none[rest] + 100) >= best[row[rest]]]
        part = parts(rest)
        rest, part = rest[part >= FALLBACK], part[part >= FALLBACK]
        value = self.each(self.bound, (1, 1), s[rest], ms[rest])
        rest, part, value = (x[value >= SECOND] for x in (rest, part, value))
        if row is None:
            take(rest, part)
        else:
            most = score(rest, value, part)
            order = np.lexsort((-most, row[rest]))
            top = order[np.flatnonzero(np.diff(row[rest[order]], prepend=-1))]  # the most promising pair of each row, then all that may still be better
            for wanted in (top, np.setdiff1d(np.arange(len(rest)), top)):
                wanted = wanted[most[wanted] >= best[row[rest[wanted]]]]
                take(rest[wanted], part[wanted])
        return found, got, kind[found]


KINDS = np.array(["primary_exact", "primary_fuzzy", "fallback"], object)


def _first(gi: np.ndarray, mi: np.ndarray, dist: np.ndarray, seq: np.ndarray, row: np.ndarray, scored: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of scored pairs the best of each row: score, then distance, then primary before fallback, then the first."""
    at, score, kind = scored
    order = np.lexsort((seq[mi[at]], kind == 2, dist[at], -score, row[at]))
    order = order[np.flatnonzero(np.diff(row[at[order]], prepend=-1))]
    return at[order], score[order], kind[order]


def _scored(truth: DataFrame, model: DataFrame, key: str, second: str | None, synonyms: str | None, window: int, every: bool, errors: bool, head_ratio, second_ratio, part_ratio) -> DataFrame:
    width = max(WIDE_BUCKET, 2 * window)
    stride = width + 4 * window + 1

    def buckets(side: int) -> Column:
        number = lambda c: F.floor(c / width)
        return F.array_distinct(F.array(*[number(F.col("seq") + i) for i in (-window, window)])) if side else number(F.col("seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _whole_groups(batches):
            scores = _Scores(table, head_ratio, second_ratio, part_ratio)
            side, seq, bucket = (table.column(c).to_numpy() for c in ("side", "seq", "bucket"))
            place = group * stride + (seq - bucket * width)
            g, m = np.flatnonzero((side == 0) & ~scores.empty[0][scores.key]), np.flatnonzero(side == 1)
            row, at = _ranges(np.searchsorted(place[m], place[g] - window, "left"), np.searchsorted(place[m], place[g] + window, "right"))
            if not len(row):
                continue
            gi, mi = g[row], m[at]
            dist = np.abs(seq[gi] - seq[mi])
            one = np.cumsum(np.diff(place[g], prepend=place[g[0]]) != 0)[row]  # rows of one number are one
            found = scores.run(gi, mi, dist, None if every else one)
            at, score, kind = found if every else _first(gi, mi, dist, seq, one, found)
            gi, mi = gi[at], mi[at]
            out = [table.column("page").combine_chunks().take(pa.array(gi)), pa.array(seq[gi]), pa.array(seq[mi]), pa.array(dist[at]), pa.array(KINDS[kind], pa.string()), pa.array(score)]
            if errors:
                for codes, texts in ((scores.key, scores.texts[0]), (scores.two, scores.texts[1])):
                    size = np.array([len(t) for t in texts], np.int64)
                    x, y = codes[gi], codes[mi]
                    far = np.zeros(len(gi), np.int64)
                    differ = np.flatnonzero(x != y)
                    far[differ] = M.distances([texts[i] for i in x[differ].tolist()], [texts[i] for i in y[differ].tolist()])
                    out += [pa.array(size[x]), pa.array(size[y]), pa.array(far)]
            yield pa.RecordBatch.from_arrays(out, names=names)

    names = ["page", *(x.split()[0] for x in FOUND.split(", ")), *(ERRORS if errors else ())]
    rows = _both_sides(truth.filter("page is not null and seq is not null"), model.filter("page is not null and seq is not null"), key, second, synonyms, buckets)
    return rows.mapInArrow(run, ", ".join([f"page {dict(rows.dtypes)['page']}", FOUND, *(f"{c} long" for c in ERRORS if errors)]))


def scored_candidates(truth: DataFrame, model: DataFrame, key: str, second: str | None, synonyms: str | None = None, window: int = WINDOW, head_ratio=M.plain_ratio, second_ratio=M.plain_token_set_ratio, part_ratio=M.plain_partial_ratio) -> DataFrame:
    """page, gt_seq, llm_seq, dist, kind, score of all pairs in a window that match."""
    return _scored(truth, model, key, second, synonyms, window, True, False, head_ratio, second_ratio, part_ratio)


def align_static(truth: DataFrame, model: DataFrame, key: str, second: str | None, synonyms: str | None = None, window: int = WINDOW, errors: bool = False, head_ratio=M.plain_ratio, second_ratio=M.plain_token_set_ratio, part_ratio=M.plain_partial_ratio) -> DataFrame:
    """Best match of each ground-truth row within a window around its own place: no state, any page size. As best_match gives it.

    Similarities given instead of the usual ones have to be at most 100. errors adds ERRORS.
    """
    return _scored(truth, model, key, second, synonyms, window, False, errors, head_ratio, second_ratio, part_ratio)


def unmatched(rows: DataFrame, matches: DataFrame, seq: str) -> DataFrame:
    """Rows of one side that no match names: seq is llm_seq for the model's rows, gt_seq for the ground truth's.

    A ground-truth row that align_sequential gives without a model row isn't matched.
    """
    taken = matches.filter("llm_seq is not null").select("page", F.col(seq).alias("seq")).distinct()
    return rows.join(taken, ["page", "seq"], "left_anti")


def align_sequential(truth: DataFrame, model: DataFrame, key: str, second: str | None, synonyms: str | None = None, window: int = WINDOW) -> DataFrame:
    """page, gt_seq, llm_seq, kind, score with a window that moves on with the highest match so far.

    The window depends on the rows before, so a page is one group; use align_static where a page is too
    large for a task. Unmatched rows have a null llm_seq. A model row may serve several rows. Many pages
    go on row by row side by side, so that their pairs are scored together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _whole_groups(batches):
            scores = _Scores(table, M.plain_ratio, M.plain_token_set_ratio, M.plain_partial_ratio)
            side, seq = (table.column(c).to_numpy() for c in ("side", "seq"))
            first = np.searchsorted(group, np.arange(group[-1] + 1))
            end = np.append(first[1:], len(group))
            n = np.bincount(group, side == 0).astype(np.int64)
            middle, place = first + n, np.arange(len(group))
            last, llm, kind, score = np.full(len(n), -1), np.full(len(group), -1), np.zeros(len(group), np.int64), np.zeros(len(group))
            for i in range(int(n.max())):
                on = np.flatnonzero(n > i)
                on = on[~scores.empty[0][scores.key[first[on] + i]]]
                low, high = np.maximum(0, np.minimum(i, last[on] + 1) - window), np.minimum((end - middle)[on], np.maximum(i, last[on] + 1) + window + 1)
                row, j = _ranges(low, high)
                if not len(row):
                    continue
                gi, mi, dist = first[on][row] + i, middle[on][row] + j, np.abs(j - i)
                at, now, how = _first(gi, mi, dist, place, row, scores.run(gi, mi, dist, row))
                llm[gi[at]], kind[gi[at]], score[gi[at]] = mi[at], how, now
                page = on[row[at]]
                last[page] = np.maximum(last[page], j[at])
            g = np.flatnonzero(side == 0)
            alone = llm[g] < 0
            yield pa.RecordBatch.from_arrays([table.column("page").combine_chunks().take(pa.array(g)), pa.array(seq[g]), pa.array(seq[llm[g]], mask=alone), pa.array(KINDS[kind[g]], pa.string(), mask=alone), pa.array(score[g], mask=alone)], names=["page", "gt_seq", "llm_seq", "kind", "score"])

    long = lambda d: d.withColumns({c: F.col(c).cast("long") for c in ("page", "seq")})
    rows = _both_sides(long(truth), long(model), key, second, synonyms, lambda side: F.array(F.lit(0)) if side else F.lit(0))
    return rows.mapInArrow(run, "page long, gt_seq long, llm_seq long, kind string, score double")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of value * weight over the sum of weights, NaN where that is 0."""
    return F.when(F.sum(weight) > 0, F.sum(value * weight) / F.sum(weight)).otherwise(F.lit(float("nan")))


def page_field_metrics(truth: DataFrame, model: DataFrame, matches: DataFrame, fields: list[str], denominator: str = "model") -> DataFrame:
    """page, field, gt_count, llm_count, matched, chars, cer: of every page on either side.

    cer is weighted by the normalised ground-truth lengths of matched pairs, NaN without characters.
    """
    long = lambda d, v: d.unpivot(["page", "seq"], fields, "field", v)
    g, m = long(truth.select("page", "seq", *fields), "gt_value"), long(model.select("page", "seq", *fields), "llm_value")
    pairs = g.withColumnRenamed("seq", "gt_seq").join(matches.select("page", "gt_seq", "llm_seq").filter("llm_seq is not null"), ["page", "gt_seq"])
    pairs = pairs.join(m.withColumnRenamed("seq", "llm_seq"), ["page", "llm_seq", "field"])
    a, b = T.null_to_empty(F.col("llm_value")), T.null_to_empty(F.col("gt_value"))
    n = F.length(T.normalize_string(b))
    done = pairs.select("page", "field", n.alias("n"), M.cer(a, b, denominator, M.distance).alias("cer"))
    return _page_metrics(truth, model, done, fields)


def page_field_errors(truth: DataFrame, model: DataFrame, matches: DataFrame, fields: dict[str, str], denominator: str = "model") -> DataFrame:
    """page_field_metrics from the ERRORS of align_static, whose distances are those of the rows' normalised keys: no text is read again.

    fields: names of fields, with key or second for each.
    """
    def error(c: str) -> Column:
        a, b = F.col(f"{c}_model"), F.col(f"{c}_truth")
        return F.when((a == 0) & (b == 0), 0.0).when((a == 0) | (b == 0), 1.0).otherwise(F.col(f"{c}_distance") / (a if denominator == "model" else b))

    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{c}_truth").alias("n"), error(c).alias("cer")) for f, c in fields.items()]))
    return _page_metrics(truth, model, matches.select("page", each.alias("e")).select("page", "e.*"), list(fields))


def _page_metrics(truth: DataFrame, model: DataFrame, pairs: DataFrame, fields: list[str]) -> DataFrame:
    done = pairs.groupBy("page", "field").agg(F.count("*").alias("matched"), F.sum("n").alias("chars"), weighted_mean(F.col("cer"), F.col("n")).alias("cer"))
    g, m = (d.groupBy("page").agg(F.count("*").alias(n)) for d, n in ((truth, "gt_count"), (model, "llm_count")))
    counts = g.join(m, "page", "full").withColumn("field", F.explode(F.array(*map(F.lit, fields))))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return counts.join(done, ["page", "field"], "left").select("page", "field", *[zero(c) for c in ("gt_count", "llm_count", "matched", "chars")], F.coalesce("cer", F.lit(float("nan"))).alias("cer"))


def page_coverage(truth: DataFrame, model: DataFrame) -> DataFrame:
    """page, gt_count, llm_count, side: both, only in the ground truth, or only in the output."""
    g, m = (d.groupBy("page").agg(F.count("*").alias(n)) for d, n in ((truth, "gt_count"), (model, "llm_count")))
    side = F.when(F.col("llm_count").isNull(), "truth").when(F.col("gt_count").isNull(), "model").otherwise("both")
    return g.join(m, "page", "full").select("page", F.coalesce("gt_count", F.lit(0)).alias("gt_count"), F.coalesce("llm_count", F.lit(0)).alias("llm_count"), side.alias("side"))


def unaligned(truth: DataFrame, model: DataFrame) -> DataFrame:
    """Ground-truth rows of pages that the output lacks."""
    return truth.join(model.select("page").distinct(), "page", "left_anti")


def chart_series(metrics: DataFrame, top: float = 2.0, every: int = 10) -> DataFrame:
    """page, field, pos (of the page in its field), value (clipped, NaN kept), tick (on every tenth page).

    Positions come from ranges of pages and their counts, so no task gets all pages of a field. The metrics are
    written first: the ranges are chosen by a look at them.
    """
    m = written(metrics.select("page", "field", "cer"), "metrics")
    m = written(m.repartitionByRange("field", "page").sortWithinPartitions("field", "page").withColumn("id", F.monotonically_increasing_id()), "positions")
    m = m.withColumn("range", F.shiftright("id", 33))
    ranges = m.groupBy("field", "range").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("field").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pos = F.col("before") + F.col("id") - F.col("first")
    m = m.join(F.broadcast(ranges.select("field", "range", "first", before.alias("before"))), ["field", "range"]).withColumn("pos", pos)
    return m.select("page", "field", "pos", F.when(F.isnan("cer"), F.col("cer")).otherwise(F.least("cer", F.lit(top))).alias("value"), F.when(F.col("pos") % every == 0, F.col("page").cast("string")).otherwise("").alias("tick"))


def judgements(rows: DataFrame, word: str, sense: str, flags: list[str], label_flag: str) -> DataFrame:
    """One row: share of senses whose flag is yes on any of their rows, and share of rows with a good label."""
    per = rows.groupBy(word, sense).agg(*[F.max(f).alias(f) for f in flags])
    share = per.agg(F.count("*").alias("senses"), *[F.round(F.avg(F.col(f).cast("double")), 6).alias(f) for f in flags])
    return share.crossJoin(F.broadcast(rows.agg(F.count(label_flag).alias("labels"), F.round(F.avg(F.col(label_flag).cast("double")), 6).alias(label_flag))))


def agreement(answers: DataFrame, item: str, model: str, answer: str) -> DataFrame:
    """model_a, model_b, items, share of items on which both give the same answer. Few models answer an item."""
    a = answers.select(item, F.col(model).alias("model_a"), F.col(answer).alias("x"))
    b = answers.select(item, F.col(model).alias("model_b"), F.col(answer).alias("y"))
    p = a.join(b, item).filter("model_a < model_b")
    return p.groupBy("model_a", "model_b").agg(F.count("*").alias("items"), F.round(F.avg(F.col("x").eqNullSafe(F.col("y")).cast("double")), 6).alias("share"))


def columns_to_load(available: list[str], *wanted: list[str | None]) -> list[str]:
    """The wanted columns that a table has, each once, in the table's order."""
    asked = {c for group in wanted for c in group if c}
    return [c for c in available if c in asked]
