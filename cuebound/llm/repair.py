"""Find documents with text that was decoded with a wrong character encoding, and restore what can be restored."""

from __future__ import annotations

import itertools
import random
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuebound.llm import mojibake as M
from cuebound.session import written

#: Characters handled at a time.
SLICE_CHARS = 4_000_000
#: A language with at least this share of all rows has a model of its own (so there are at most 1 / LEAST_SHARE).
LEAST_SHARE = 0.03
#: The margins are validated on all documents: each tenth of them by hash with a model trained on the others, in blocks of about so
#: many documents, which give each other words for examples.
FOLDS, BLOCK_DOCS = 10, 128
_MODELS: dict[str, M.Model] = {}


def _joined(texts: list[str | None]) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """(index of the first text, texts, code points of the texts with a line end after each, where each begins)."""
    begin, chars, part = 0, 0, []
    for i, text in enumerate(texts):
        part.append(text or "")
        chars += len(part[-1])
        if chars >= SLICE_CHARS or i == len(texts) - 1:
            sizes = np.fromiter((len(t) + 1 for t in part), np.int64, len(part))
            yield begin, part, M.points("\n".join(part) + "\n"), np.cumsum(sizes) - sizes
            begin, chars, part = i + 1, 0, []


def _counts(rows: DataFrame, languages: list[str]) -> tuple[M.Counts, list[M.Counts], int]:
    """(counts of neighbours, the same of each fold, number of documents) over the rows (h, language, text) that look clean.

    Counts are added up by the executors; the driver gets one number for each fold, language and pair of classes that occurs.
    """
    known = {name: i + 1 for i, name in enumerate(languages)}
    each = len(known) + 1
    kinds = ["slot", "pair", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line_end, waiting, held, docs = M._CLASS[10], {}, 0, 0

        def added() -> Iterator[pa.RecordBatch]:
            for slot, codes in waiting.items():
                total = np.bincount(np.concatenate(codes), minlength=M.K * M.K)
                pair = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), slot), pa.int32()), pa.array(pair, pa.int32()), pa.array(total[pair], pa.int64())], names=kinds)
            waiting.clear()

        for batch in batches:
            slots = np.array([h % FOLDS * each + known.get(name, 0) for h, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            order = np.argsort(slots, kind="stable")
            texts = batch.column(2).take(pa.array(order)).to_pylist()
            slots = slots[order]
            for first, part, at, starts in _joined(texts):
                fit = M.fit_for_training(at, starts)
                mine = slots[first : first + len(part)]
                docs += int(fit.sum())
                ends = np.append(starts[1:], len(at))
                classes, inside = M._CLASS[at], np.repeat(fit, ends - starts)
                for slot in np.unique(mine[fit]):
                    i, j = np.searchsorted(mine, [slot, slot + 1])
                    a, b = starts[i], ends[j - 1]
                    kept = np.append(line_end, classes[a:b][inside[a:b]])  # each document between two line ends, wherever it comes
                    waiting.setdefault(int(slot), []).append(M.pair_codes(kept))
                    held += len(kept)
                if held >= 2 * SLICE_CHARS:
                    yield from added()
                    held = 0
        yield from added()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([docs], pa.int64())], names=kinds)

    found = rows.select("h", "language", "text").mapInArrow(count, "slot int, pair int, n bigint").groupBy("slot", "pair").agg(F.sum("n").alias("n")).toPandas().sort_values(["slot", "pair"])
    clean = int(found.loc[found["slot"] == -1, "n"].sum())
    found = found[found["slot"] >= 0]

    def counts(part) -> M.Counts:  # noqa: ANN001
        sums = lambda x: (lambda n: (n.index.to_numpy(np.int64), n.to_numpy(np.int64)))(x.groupby("pair")["n"].sum())
        return M.Counts({None: sums(part)} | {name: sums(part[part["slot"] % each == slot]) for name, slot in known.items()})

    return counts(found), [counts(found[found["slot"] // each == fold]) for fold in range(FOLDS)], clean


def _model(name: str, counts: M.Counts) -> M.Model:
    """The model of counts, built once in each worker."""
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = M.Model(counts)
    return _MODELS[name]


def _suspects(texts: list[str | None], model: M.Model, hopes: M.Hopes) -> Iterator[tuple[int, str, bool, list[tuple[int, int]]]]:
    """(index, text, whether it looks clean, suspicious stretches) of the texts in which characters meet as they rarely do in clean
    text, in which there are entities, or which another encoding may make much likelier (hopes). All of every text is looked at."""
    for begin, part, at, starts in _joined(texts):
        odd = model.suspicious(M._CLASS[at])  # position i: characters i and i + 1
        ends = np.append(starts[1:], len(at))
        first, last = np.searchsorted(odd, starts - 1), np.searchsorted(odd, ends - 1)
        words = [M.blanks(t) for t in part]
        hopes.learn(words)
        found = []
        for i, t in enumerate(part):
            entity = "&" in t and M._ENTITY.search(t)
            likelier = hopes.likelier(words[i])
            if first[i] == last[i] and not entity and not likelier:
                continue
            mine = odd[first[i] : last[i]] - starts[i]
            spans = M.stretches(t)
            hits = np.searchsorted(mine, [b - 1 for b, _ in spans]) < np.searchsorted(mine, [e for _, e in spans])
            kept = [s for s, hit in zip(spans, hits, strict=True) if hit or likelier and hopes.likelier(M.blanks(t[s[0] : s[1]])) or entity and M._ENTITY.search(t, *s)]
            if kept:
                found.append((i, kept))
        if found:
            index = np.array([i for i, _ in found])
            mask = np.zeros(len(part), bool)
            mask[index] = True
            sizes = (ends - starts)[index]
            fit = M.fit_for_training(at[np.repeat(mask, ends - starts)], np.cumsum(sizes) - sizes)
            for (i, kept), clean in zip(found, fit, strict=True):
                yield begin + i, part[i], bool(clean), kept


_READINGS = "h bigint, language string, text string, looks_clean boolean, begins array<int>, ends array<int>, gains array<double>, fits array<double>, originals array<string>, chains array<string>"


def _read(t: str, spans: list[tuple[int, int]], model: M.Model, hopes: M.Hopes, enough: bool) -> list[tuple]:
    """(begin, end, reading) of the stretches of t that have a garbled reading; where one that counts by any margin is enough, up to
    that."""
    found = []
    for b, e in spans:
        v = M.judge(t[b:e], model, hopes)
        if v.chain:
            found.append((b, e, v))
            if enough and v.gain >= M.SURE and v.fit >= M.SURE:
                break
    return found


def _readings(rows: DataFrame, counts: M.Counts, every: bool) -> DataFrame:
    """The rows (id, h, language, text) with suspicious stretches, and of each such stretch that has a garbled reading the likeliest:
    its place, gain, fit, original and chain. Without every, documents that do not look clean are read up to the first stretch
    that counts by any margin (margins are at most M.SURE). Written once."""
    shared, name = rows.sparkSession.sparkContext.broadcast(counts), uuid.uuid4().hex

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(name, shared.value)
        hopes = M.Hopes(model)
        for batch in batches:
            index, columns = [], [[] for _ in range(7)]
            for i, t, clean, spans in _suspects(batch.column(3).to_pylist(), model, hopes):
                found = _read(t, spans, model, hopes, not every and not clean)
                if found:
                    index.append(i)
                    row = [clean, *map(list, zip(*((b, e, v.gain, v.fit, v.text, v.chain) for b, e, v in found), strict=True))]
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            if index:
                types = [pa.bool_(), *map(pa.list_, (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.string()))]
                arrays = [pa.array(c, kind) for c, kind in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([c.take(pa.array(index)) for c in batch.columns] + arrays, names=["id", *(x.split()[0] for x in _READINGS.split(", "))])

    rows = rows.select("id", "h", "language", "text")
    return written(rows.mapInArrow(read, f"id {rows.schema['id'].dataType.simpleString()}, {_READINGS}"), "readings")


def _histogram(readings: DataFrame, clean: int) -> np.ndarray:
    """In how many documents that look clean the largest gain of a reading falls into each bin; 0 where there is no reading, or only
    an example."""
    gains = F.filter(F.arrays_zip("gains", "fits"), lambda x: x["fits"] >= 0)
    top = F.least(F.lit(1e4), F.coalesce(F.array_max(F.transform(gains, lambda x: x["gains"])), F.lit(0.0)))
    at = F.least(F.lit(M.BINS - 1), F.greatest(F.lit(0), F.floor((top - M.LOWEST) / M.STEP)))
    found = np.zeros(M.BINS, np.int64)
    for r in readings.where("looks_clean").groupBy(at.cast("int").alias("bin")).count().collect():  # at most BINS rows
        found[r["bin"]] += r["count"]
    found[M.bin_of(0.0)] += max(0, clean - int(found.sum()))
    return found


@dataclass
class Validation:
    """The margins and what they were validated by: shares of right cases that would be accepted and of garbled ones that would not
    be, by gain and by fit, and the share of garbled held-out stretches that come back as they were."""

    margin: float
    right_gain: float
    garbled_gain: float
    example_margin: float
    right_fit: float
    garbled_fit: float
    restored: float
    cases: int


#: The largest margins: what they accept counts whatever the validation says.
_SURE = Validation(M.SURE, 0.0, 0.0, M.SURE, 0.0, 0.0, 0.0, 0)


def _cases(model: M.Model, sample: list[str], seed: int = 0, hopes: M.Hopes | None = None) -> np.ndarray:
    """What validate counts, of one block of documents: bins of the gains and fits of garbled stretches and of the fits of examples (three
    rows), and in a fourth row how many garbled stretches come back and how many there are. hopes may be kept from block to block."""
    hopes, rng = M.Hopes(model) if hopes is None else hopes, random.Random(seed)
    chains = [("utf-8", w) for w in M.READ_AS] + [(t, w) for w, t in M.LEGACY]
    texts = [t for t in sample if M.fit_for_training(M.points(t + "\n"), np.array([0]))[0]]
    right = [t[b:e] for t in texts for b, e in M.stretches(t)]
    words = [w for s in right for w in s.split() if not w.isascii() and len(w) <= 24]
    garbled, examples, in_turn = [], [], itertools.islice(itertools.cycle(chains), seed % len(chains), None)
    for i, s in enumerate(right):
        for _ in range(2):
            bad = M.garble(s, *next(in_turn))
            if bad is not None:
                garbled.append((bad, s))
        bad = M.garble(rng.choice(words), *rng.choice(chains)) if words else None
        if bad is not None:
            tokens = s.split(" ")
            tokens.insert(rng.randint(0, len(tokens)), f'"{bad}"' if i % 2 else bad)
            examples.append(" ".join(tokens))
    words_of = [M.blanks(bad) for bad in [*(bad for bad, _ in garbled), *examples]]
    hopes.learn(words_of)
    model.prepare(itertools.chain((bad for bad, _ in garbled), examples, right))
    found = np.zeros((4, M.BINS), np.int64)
    for bad, s in garbled:
        v = M.judge(bad, model, hopes)
        found[3, 0] += v.text == s
        found[0, M.bin_of(v.gain)] += 1
        found[1, M.bin_of(v.fit if v.chain else M.LOWEST)] += 1
    found[3, 1] = len(garbled)
    for bad in examples:
        v = M.judge(bad, model, hopes)
        found[2, M.bin_of(v.fit if v.chain and v.gain >= M.EVIDENCE else M.LOWEST)] += 1
    return found


def _margins(right_gains: np.ndarray, cases: np.ndarray) -> Validation:
    gains, fits, shown, (back, n, *_) = cases
    margin, fp, fn = M.threshold(right_gains, gains, M.EVIDENCE)
    example, efp, efn = M.threshold(shown, fits, 0.0)
    return Validation(margin, fp, fn, example, efp, efn, int(back) / max(1, int(n)), int(n))


def validate(model: M.Model, right_gains: np.ndarray, sample: list[str]) -> Validation:
    """Choose the margins. Gains of garbled text are those of held-out stretches that look clean, each garbled through some of all
    the chains in turn; gains of right text those of all documents that look clean (right_gains). Fits of examples are those of the
    held-out stretches with one word, of any of them, garbled and put in, in every other case between quotation marks."""
    return _margins(right_gains, _cases(model, sample))


def _validated(rows: DataFrame, counts: M.Counts, folds: list[M.Counts], docs: int) -> np.ndarray:
    """The cases of all documents, each fold's by the model of the others' counts. Texts that repeat count once. A block is a task's at
    once, and blocks and seeds follow from the texts' hashes, so that neither order nor partitions matter. A task has blocks of one
    fold, so that it builds one model and scores a word once."""
    spark = rows.sparkSession
    shared, name = spark.sparkContext.broadcast((counts, folds)), uuid.uuid4().hex
    blocks = FOLDS * max(1, docs // (FOLDS * BLOCK_DOCS))
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    of_fold = min(blocks // FOLDS, -(-tasks // FOLDS))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, keys = np.zeros((4, M.BINS), np.int64), (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        hopes = None
        for (fold, block), group in itertools.groupby(keys, lambda x: x[:2]):
            texts = [next(same)[3] for _, same in itertools.groupby(group, lambda x: x[2])]
            model = _fold_model(f"{name}-{fold}", shared.value, fold)
            hopes = hopes if hopes is not None and hopes.model is model else M.Hopes(model)
            total += _cases(model, texts, block, hopes)
        kind, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(at, pa.int32()), pa.array(total[kind, at], pa.int64())], names=["kind", "at", "n"])

    block = F.pmod("h", F.lit(blocks)).cast("int")
    fold, task = block % FOLDS, F.floor(block / FOLDS).cast("int") % of_fold
    placed = rows.select(fold.alias("fold"), block.alias("block"), "h", "text", (fold * of_fold + task).alias("task")).repartitionById(FOLDS * of_fold, "task")
    placed = placed.drop("task").sortWithinPartitions("fold", "block", "h", "text")
    found = np.zeros((4, M.BINS), np.int64)
    for r in placed.mapInArrow(check, "kind int, at int, n bigint").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect():  # at most 4 * BINS rows
        found[r["kind"], r["at"]] = r["n"]
    return found


def _fold_model(name: str, shared: tuple[M.Counts, list[M.Counts]], fold: int) -> M.Model:
    """The model of all counts but a fold's, built once in each worker."""
    return _MODELS[name] if name in _MODELS else _model(name, shared[0].less(shared[1][fold]))


def _accepted(v: Validation):  # noqa: ANN202
    """How many stretches of a row of readings count as garbled."""
    good = F.transform(F.arrays_zip("gains", "fits"), lambda x: (x["gains"] >= v.margin) & (x["fits"] >= v.example_margin))
    return F.size(F.filter(good, lambda x: x))


def read_garbled(docs: DataFrame, key: str, text: str, language: str | None = None, every: bool = True) -> tuple[DataFrame, Validation]:
    """(readings of all documents with a suspicious stretch, the margins); see _readings for every.

    Models are trained on all documents that look clean; the readings that they find and accept in
    documents that looked clean are taken out of the training, and the models are fitted again, until none is left. First those
    that count by any margin are taken out. With the models fitted without them the made cases of all documents are judged; then
    those that the margins accept are taken out. The cases are judged again only if these are more than M.NOISE of the training;
    the margins follow the right gains of each round in any case.
    Documents that are suspicious and were not both found and left out of the training anyway are read again with the new models;
    all documents only where neighbours that still occur have become rare.
    """
    name = F.col(language) if language else F.lit(None)
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("h"), name.cast("string").alias("language"), F.col(text).alias("text")).where("text IS NOT NULL")
    languages: list[str] = []
    if language:
        sizes = rows.groupBy("language").count()
        of_all = sizes.withColumn("of_all", F.col("count") / F.sum("count").over(Window.partitionBy()))  # one row a language
        languages = sorted(r.language for r in of_all.where(F.col("language").isNotNull() & (F.col("of_all") >= LEAST_SHARE)).collect())
    everything, every_fold, clean = _counts(rows, languages)
    counts, folds, source, found_before, taken, cases, judged = everything, every_fold, rows, None, 0, None, 0
    while True:
        model = M.Model(counts)
        readings = _readings(source, counts, every)
        for validated in (False, True):
            if validated and (cases is None or judged - counts.total > M.NOISE * judged):
                cases, judged = _validated(rows, counts, folds, clean), counts.total
            v = _margins(_histogram(readings, clean), cases) if validated else _SURE
            gone, gone_folds, _ = _counts(readings.where(F.col("looks_clean") & (_accepted(v) > 0)), languages)
            if gone.total > taken:
                break
        else:
            return readings if found_before is None else readings.union(found_before), v
        taken, counts, folds = gone.total, everything.less(gone), [x.less(y) for x, y in zip(every_fold, gone_folds, strict=True)]
        newly = M.Model(counts).rare & ~model.rare
        pairs, left = counts.by_language[None]
        if bool((newly[pairs] & (left > 0)).any()):
            source, found_before = rows, None
        else:
            open_rows = F.col("looks_clean") | (_accepted(v) == 0)
            found = readings.where(~open_rows)
            source, found_before = readings.where(open_rows), found if found_before is None else found_before.union(found)


def find_garbled(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str | None = None) -> DataFrame:
    """(key) of each row of docs of which at least one stretch was decoded with a wrong encoding, restorable or not.

    language names a column of language tags, if there is one: languages get models of their own. Null, empty and blank texts
    are not garbled; a right text that shows such characters as an example is not; rows that repeat come out as often as
    they are there; an empty table gives no rows.
    """
    readings, v = read_garbled(docs, key, text, language, every=False)
    return readings.where(_accepted(v) > 0).select(F.col("id").alias(key))


def restore_garbled(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str | None = None) -> DataFrame:
    """(key, n_garbled, n_restored, chains, restored_text) of each row that find_garbled finds: how many stretches are garbled and
    how many of them came back, by which chains, and the whole text with these put in. What is lost stays as it is."""
    readings, v = read_garbled(docs, key, text, language)
    kind = readings.schema["id"].dataType.simpleString()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for t, *stretches in zip(*(batch.column(c).to_pylist() for c in range(1, 8)), strict=True):
                pieces, at, garbled, restored, chains = [], 0, 0, 0, set()
                for b, e, gain, fit, original, chain in zip(*stretches, strict=True):
                    if gain < v.margin or fit < v.example_margin:
                        continue
                    garbled += 1
                    chains.add(chain)
                    if original is not None:
                        restored += 1
                        pieces += [t[at:b], original]
                        at = e
                for column, value in zip(out, (garbled, restored, ", ".join(sorted(chains)), "".join([*pieces, t[at:]])), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=[key, "n_garbled", "n_restored", "chains", "restored_text"])

    found = readings.where(_accepted(v) > 0).select("id", "text", "begins", "ends", "gains", "fits", "originals", "chains")
    return found.mapInArrow(put, f"`{key}` {kind}, n_garbled bigint, n_restored bigint, chains string, restored_text string")
