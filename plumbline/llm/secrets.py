"""Secret scans: fixed patterns find what surely is a secret, a character network finds what looks like one.

Every text is read once.  It gives the spans of the fixed patterns and its candidates: runs of at least ``LEAST`` token characters with a digit,
with ``CONTEXT`` characters on either side.  A convolutional network over one-hot characters is trained on all distinct candidates, labelled by
whether a pattern found them, with the context of half of them hidden, so that it learns what the secrets themselves look like: every block of candidates
goes on from the common parameters for an epoch, and their means are the next ones.  Its scores are calibrated on held-out candidates
and cut, per kind of alphabet, at the highest threshold that still keeps ``RECALL`` of the held-out secrets.  It then scores every candidate.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.common import free, stored, with_columns
from plumbline.operators.ordering import row_index

# fixed values: the patterns of the contract, with the fewest characters of the counted group
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
MODEL = "model"
LEAST, CONTEXT = 12, 24
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{%d,}={0,2}" % LEAST)
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
DIGIT = re.compile(r"[0-9]")
#: distinct candidates that one task learns from between two averages, about
BLOCK_ROWS = 4_096
RECALL = 0.99
#: labelled secrets of one alphabet below which its threshold is the common one
FEW = 20
WIDTH, FILTERS, HIDDEN = 5, 24, 16
SYMBOLS = 97  # printable ASCII, any other character, nothing
NOTHING = SYMBOLS - 1
#: characters that are convolved at once
POSITIONS = 1 << 15
EPOCHS, BATCH, RATE = 8, 128, 0.01

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
CANDIDATES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("before", "value", "after")] + [T.StructField(n, T.IntegerType()) for n in ("start", "end")]
                                      + [T.StructField("found", T.BooleanType())]))
SCORED = T.ArrayType(T.StructType([*SPAN.elementType.fields, T.StructField("score", T.DoubleType())]))


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and non-overlapping per kind, by start and then by kind."""
    out = []
    for kind in KINDS:
        pattern, group, least = PATTERNS[kind]
        # what rules a whole text out at once; runs of hex digits that are too short need not be looked at
        if kind == "assign" and "=" not in text and ":" not in text or kind == "access" and "AKIA" not in text:
            continue
        for m in (LONG_HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str, spans: list[tuple[str, int, int]]) -> list[dict[str, object]]:
    """Candidates of a text; ``found`` are those that a span overlaps."""
    if not DIGIT.search(text):
        return []
    out = []
    for m in CANDIDATE.finditer(text):
        value = m.group().rstrip(".")
        if len(value) < LEAST or not DIGIT.search(value):
            continue
        start, end = m.start(), m.start() + len(value)
        out.append({"before": text[max(0, start - CONTEXT):start], "value": value, "after": text[end:end + CONTEXT], "start": start, "end": end,
                    "found": any(a < end and start < b for _, a, b in spans)})
    return out


def scan(docs: DataFrame, text: str, keep: list[str], names: tuple[str, str]) -> DataFrame:
    """``keep`` columns with the pattern spans and the candidates of every text, under ``names``."""
    kinds = to_arrow_type(SPAN), to_arrow_type(CANDIDATES)

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        spans, found = [], []
        for raw in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist():
            own = (raw or b"").decode("utf-8", "replace")
            spans.append(pattern_spans(own))
            found.append(candidates(own, spans[-1]))
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]
        return {names[0]: pa.array(rows, type=kinds[0]), names[1]: pa.array(found, type=kinds[1])}

    own = free(docs, "text_")
    return with_columns(docs.withColumn(own, F.col(text).cast("string")), {names[0]: SPAN, names[1]: CANDIDATES}, run, keep, [own])


# ---- the network -----------------------------------------------------------------------------

_CODE = np.full(256, SYMBOLS - 2, np.int64)
_CODE[32:127] = np.arange(95)


def encode(before: list[str], value: list[str], after: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows in a row, with room between them, and the window of each position (-1 between).

    A code is the symbol, plus ``SYMBOLS`` inside the candidate.
    """
    codes, owner, gap = [], [], np.full(WIDTH - 1, NOTHING)
    for i, parts in enumerate(zip(before, value, after)):
        codes.append(gap)
        owner.append(np.full(WIDTH - 1, -1))
        for k, part in enumerate(parts):
            own = _CODE[np.frombuffer(part.encode("latin-1", "replace"), np.uint8)] if part.isascii() else np.array([_CODE[ord(c)] if ord(c) < 128 else SYMBOLS - 2 for c in part], np.int64)
            codes.append(own + SYMBOLS * (k == 1))
            owner.append(np.full(len(own), i))
    codes.append(gap)
    owner.append(np.full(WIDTH - 1, -1))
    return np.concatenate(codes), np.concatenate(owner)


def new_parameters(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {"conv": rng.normal(0, 0.3, (WIDTH, 2 * SYMBOLS, FILTERS)), "shift": np.zeros(FILTERS), "mix": rng.normal(0, 1 / np.sqrt(3 * FILTERS), (3 * FILTERS, HIDDEN)),
            "mix_shift": np.zeros(HIDDEN), "out": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "out_shift": np.zeros(1)}


def convolve(codes: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Rectified filter outputs; position i sees the codes i - 2 to i + 2."""
    n = len(codes) - WIDTH + 1
    h = np.broadcast_to(p["shift"], (n, FILTERS)).copy()
    for j in range(WIDTH):
        h += p["conv"][j][codes[j:j + n]]
    return np.maximum(h, 0, out=h)


def pool(codes: np.ndarray, owner: np.ndarray, n: int, p: dict[str, np.ndarray]) -> np.ndarray:
    """Per window: largest and mean output inside the candidate, largest output around it.  Windows of any length, a bounded number of positions at a time."""
    top, total, around, size = np.zeros((n, FILTERS)), np.zeros((n, FILTERS)), np.zeros((n, FILTERS)), np.zeros(n)
    half = WIDTH // 2
    for start in range(half, len(codes) - half, POSITIONS):
        end = min(len(codes) - half, start + POSITIONS)
        h, own, inside = convolve(codes[start - half:end + half], p), owner[start:end], codes[start:end] >= SYMBOLS
        for rows, largest in ((inside, top), ((own >= 0) & ~inside, around)):
            at = np.flatnonzero(rows)
            if not len(at):
                continue
            first = np.flatnonzero(np.diff(own[at], prepend=-1))
            windows = own[at[first]]
            largest[windows] = np.maximum(largest[windows], np.maximum.reduceat(h[at], first, axis=0))
            if largest is top:
                total[windows] += np.add.reduceat(h[at], first, axis=0)
                size[windows] += np.diff(np.append(first, len(at)))
    return np.concatenate([top, total / np.maximum(size, 1)[:, None], around], axis=1)


def logits(before: list[str], value: list[str], after: list[str], p: dict[str, np.ndarray]) -> np.ndarray:
    codes, owner = encode(before, value, after)
    hidden = np.maximum(pool(codes, owner, len(value), p) @ p["mix"] + p["mix_shift"], 0)
    return hidden @ p["out"] + p["out_shift"][0]


def gradients(codes: np.ndarray, owner: np.ndarray, target: np.ndarray, weight: np.ndarray, p: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted log loss of a batch of windows and its derivatives."""
    n, half = len(target), WIDTH // 2
    h = convolve(codes, p)
    own, inside = owner[half:-half], codes[half:-half] >= SYMBOLS
    features, picks = np.zeros((n, 3 * FILTERS)), []
    at = np.flatnonzero(inside)
    size = np.bincount(own[at], minlength=n).astype(float)
    np.add.at(features[:, FILTERS:2 * FILTERS], own[at], h[at])
    features[:, FILTERS:2 * FILTERS] /= np.maximum(size, 1)[:, None]
    for rows, column in ((at, 0), (np.flatnonzero((own >= 0) & ~inside), 2)):
        order = np.lexsort([rows, own[rows]])
        rows = rows[order]
        first = np.flatnonzero(np.diff(own[rows], prepend=-1))
        for w, a, b in zip(own[rows[first]].tolist(), first.tolist(), np.append(first[1:], len(rows)).tolist()):
            best = rows[a:b][h[rows[a:b]].argmax(axis=0)]
            features[w, column * FILTERS:(column + 1) * FILTERS] = h[best, np.arange(FILTERS)]
            picks.append((w, column, best))
    hidden = features @ p["mix"] + p["mix_shift"]
    active = np.maximum(hidden, 0)
    z = active @ p["out"] + p["out_shift"][0]
    chance = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = float((weight * -np.log(np.maximum(np.where(target, chance, 1 - chance), 1e-12))).sum() / weight.sum())
    dz = weight * (chance - target) / weight.sum()
    dhidden = np.outer(dz, p["out"]) * (hidden > 0)
    dfeatures = dhidden @ p["mix"].T
    dh = np.zeros_like(h)
    dh[at] = dfeatures[own[at], FILTERS:2 * FILTERS] / size[own[at]][:, None]
    for w, column, best in picks:
        np.add.at(dh, (best, np.arange(FILTERS)), dfeatures[w, column * FILTERS:(column + 1) * FILTERS])
    dh *= h > 0
    live = np.flatnonzero(dh.any(axis=1))
    conv = np.zeros_like(p["conv"])
    for j in range(WIDTH):
        np.add.at(conv[j], codes[live + j], dh[live])
    return loss, {"conv": conv, "shift": dh.sum(axis=0), "mix": features.T @ dhidden, "mix_shift": dhidden.sum(axis=0), "out": active.T @ dz, "out_shift": np.array([dz.sum()])}


def new_state(seed: int) -> dict[str, dict[str, np.ndarray]]:
    """Parameters with Adam's two moments."""
    p = new_parameters(seed)
    return {"p": p, "first": {k: np.zeros_like(v) for k, v in p.items()}, "second": {k: np.zeros_like(v) for k, v in p.items()}}


def one_epoch(state: dict[str, dict[str, np.ndarray]], step: int, rows: list[tuple[str, str, str]], target: np.ndarray, weight: np.ndarray, bare: np.ndarray, order: np.ndarray) -> int:
    """Adam over batches of ``order``, changing ``state``; ``bare`` windows are shown without their context."""
    p, first, second = state["p"], state["first"], state["second"]
    for start in range(0, len(order), BATCH):
        mine = order[start:start + BATCH]
        none = bare[mine]
        codes, owner = encode(["" if b else rows[i][0] for i, b in zip(mine, none)], [rows[i][1] for i in mine], ["" if b else rows[i][2] for i, b in zip(mine, none)])
        _, g = gradients(codes, owner, target[mine], weight[mine], p)
        step += 1
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
            p[k] -= RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return step


def label_weights(target: np.ndarray, good: int, bad: int) -> np.ndarray:
    """Both labels weigh the same among ``good`` and ``bad`` rows in all."""
    return np.where(target, 0.5 / max(1, good), 0.5 / max(1, bad)) * (good + bad)


def train(rows: list[tuple[str, str, str]], target: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Adam over shuffled batches of one block; every window is shown with its context in one epoch and without it in the next, or the other way round."""
    rng, state, step = np.random.default_rng(seed), new_state(seed), 0
    weight = label_weights(target, int(target.sum()), int((~target).sum()))
    hidden = rng.random(len(rows)) < 0.5
    for epoch in range(EPOCHS):
        step = one_epoch(state, step, rows, target, weight, hidden ^ bool(epoch % 2), rng.permutation(len(rows)))
    return state["p"]


def flat(state: dict[str, dict[str, np.ndarray]]) -> np.ndarray:
    return np.concatenate([v.ravel() for part in state.values() for v in part.values()])


def unflat(values: np.ndarray, like: dict[str, dict[str, np.ndarray]]) -> dict[str, dict[str, np.ndarray]]:
    out, at = {}, 0
    for name, part in like.items():
        out[name] = {}
        for k, v in part.items():
            out[name][k] = values[at:at + v.size].reshape(v.shape)
            at += v.size
    return out


def _learner(now: np.ndarray, step: int, epoch: int, good: int, bad: int, seed: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("rank", "value", "before", "after", "found")])
        rows = list(zip(*[table[c].to_pylist() for c in ("before", "value", "after")]))
        target, rank = table["found"].to_numpy().astype(bool), table["rank"].to_numpy()
        own = unflat(now.copy(), new_state(seed))
        order = np.random.default_rng([seed, epoch, table["block"][0].as_py()]).permutation(len(rows))
        bare = ((rank >> 40) & 1 == 1) ^ bool(epoch % 2)  # the lowest bits deal the rows to blocks
        one_epoch(own, step, rows, target, label_weights(target, good, bad), bare, order)
        return pa.table({"at": np.arange(len(now)), "v": flat(own) * (len(rows) / (good + bad))})
    return run


def train_blocks(learn: DataFrame, good: int, bad: int, block_rows: int = BLOCK_ROWS, seed: int = 3) -> dict[str, np.ndarray]:
    """``train`` over all rows of ``learn`` (before, value, after, found, rank): in each epoch every block goes on from the common state, whose next value is the mean of theirs by rows."""
    blocks = max(1, (good + bad) // block_rows)
    dealt = learn.withColumn("block", F.pmod("rank", F.lit(blocks)).cast("int")).repartition(blocks, "block").groupBy("block")
    state, step = new_state(seed), 0
    for epoch in range(EPOCHS):
        sums = dealt.applyInArrow(_learner(flat(state), step, epoch, good, bad, seed), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        values = np.empty(len(sums))
        values[sums["at"].to_numpy()] = sums["v"].to_numpy()
        state, step = unflat(values, state), step + -(-((good + bad) // blocks) // BATCH)
    return state["p"]


def calibrate(z: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-out scores, with both labels' targets drawn in by one row; Newton's steps."""
    good, bad = target.sum(), (~target).sum()
    goal = np.where(target, (good + 1) / (good + 2), 1 / (bad + 2))
    middle, scale = float(z.mean()), float(z.std()) or 1.0
    u = np.stack([(z - middle) / scale, np.ones(len(z))], axis=1)

    def loss(line: np.ndarray) -> float:
        t = u @ line
        return float((np.logaddexp(0, t) - goal * t).sum())
    line = np.array([1.0, 0.0])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(u @ line, -30, 30)))
        move = np.linalg.solve((u * (q * (1 - q))[:, None]).T @ u + 1e-6 * np.eye(2), u.T @ (q - goal))
        while loss(line - move) > loss(line) and np.abs(move).max() > 1e-9:
            move /= 2
        line = line - move
        if np.abs(move).max() < 1e-9:
            break
    slope = max(float(line[0]), 1e-3) / scale
    return slope, float(line[1]) - slope * middle


def calibrate_rows(rows: DataFrame) -> tuple[float, float]:
    """``calibrate`` over the rows (z, found) of a table, each step an aggregation."""
    stats = rows.agg(F.count_if("found").alias("good"), F.count_if(~F.col("found")).alias("bad"), F.avg("z").alias("m"), F.stddev_pop("z").alias("s")).first()
    middle, scale = stats["m"], stats["s"] or 1.0
    u = (F.col("z") - middle) / scale
    goal = F.when(F.col("found"), (stats["good"] + 1) / (stats["good"] + 2)).otherwise(1 / (stats["bad"] + 2))

    def loss(line: np.ndarray) -> Column:
        t = u * float(line[0]) + float(line[1])
        return F.sum(F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t))) - goal * t)
    line = np.array([1.0, 0.0])
    for _ in range(100):
        q = 1 / (1 + F.exp(-F.greatest(F.least(u * float(line[0]) + float(line[1]), F.lit(30.0)), F.lit(-30.0))))
        w, miss = q * (1 - q), q - goal
        r = rows.agg(*[F.sum(x) for x in (u * u * w, u * w, w, u * miss, miss)]).first()
        move = np.linalg.solve(np.array([[r[0], r[1]], [r[1], r[2]]]) + 1e-6 * np.eye(2), np.array([r[3], r[4]]))
        halves = [move / 2 ** i for i in range(40) if i == 0 or np.abs(move).max() / 2 ** (i - 1) > 1e-9]
        losses = rows.agg(loss(line), *[loss(line - m) for m in halves]).first()
        move = next((m for m, x in zip(halves, losses[1:]) if x <= losses[0]), halves[-1])
        line = line - move
        if np.abs(move).max() < 1e-9:
            break
    slope = max(float(line[0]), 1e-3) / scale
    return slope, float(line[1]) - slope * middle


def alphabet(value: str) -> str:
    """Which characters a candidate is made of: ``digits``, ``hex``, ``upper`` (A-Z, 0-9), ``word`` (letters, digits) or ``any``."""
    for name, pattern in (("digits", r"[0-9]+"), ("hex", r"[0-9a-f]+|[0-9A-F]+"), ("upper", r"[A-Z0-9]+"), ("word", r"[A-Za-z0-9]+")):
        if re.fullmatch(pattern, value):
            return name
    return "any"


@dataclass
class Model:
    """Network, calibration and thresholds; without a network nothing is added to what the patterns find."""

    parameters: dict[str, np.ndarray] | None = None
    slope: float = 1.0
    shift: float = 0.0
    common: float = 1.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def scores(self, before: list[str], value: list[str], after: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits(before, value, after, self.parameters) + self.shift, -30, 30)))


def least_score(scores: np.ndarray, recall: float) -> float:
    """The highest threshold that at least ``recall`` of ``scores`` reach."""
    return float(np.sort(scores)[len(scores) - int(np.ceil(recall * len(scores)))])


def fit_sample(rows: list[tuple[str, str, str]], target: np.ndarray, part: np.ndarray, recall: float = RECALL) -> Model:
    """``fit`` for rows in memory: network from those of ``part`` 0 to 2, calibration from 3, thresholds from 4; equal values belong in one part."""
    def usable(mask: np.ndarray) -> bool:
        return bool(target[mask].any() and (~target[mask]).any())
    learn, curve, cut = part < 3, part == 3, part == 4
    if not (usable(learn) and usable(curve) and target[cut].any()):
        return Model()
    # context is what the patterns go by: held-out secrets count without it too
    def z(mask: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        mine = [rows[i] for i in np.flatnonzero(mask)]
        value, none = [r[1] for r in mine], [""] * len(mine)
        return np.concatenate([logits([r[0] for r in mine], value, [r[2] for r in mine], p), logits(none, value, none, p)]), np.tile(target[mask], 2)
    p = train([rows[i] for i in np.flatnonzero(learn)], target[learn])
    slope, shift = calibrate(*z(curve, p))
    model = Model(p, slope, shift)
    raw, label = z(cut, p)
    scores = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -30, 30)))
    model.common = least_score(scores[label], recall)
    kinds = np.tile([alphabet(rows[i][1]) for i in np.flatnonzero(cut)], 2)
    for kind in np.unique(kinds):
        own = scores[label & (kinds == kind)]
        if len(own) >= FEW:
            model.thresholds[str(kind)] = least_score(own, recall)
    return model


def _heights(scored: DataFrame, recall: float, by: list[str]) -> dict[object, float]:
    """Per group of ``by`` (all rows under None) the highest score that at least ``recall`` of its rows reach, exact for groups of any size."""
    sizes = scored.groupBy(*by).agg(F.count("*").alias("n")).collect()
    wanted = {r[by[0]] if by else None: r["n"] - int(np.ceil(recall * r["n"])) for r in sizes}
    placed = row_index(scored, ["z", "rank", "value", "before", "after", "bare"], by, "place")
    key = F.col(by[0]) if by else F.lit(None).cast("string")
    mine = reduce(lambda a, b: a | b, [(key.eqNullSafe(F.lit(k))) & (F.col("place") == at) for k, at in wanted.items()])
    return {r[0]: r[1] for r in placed.where(mine).select(key, "z").collect()}


def fit(scanned: DataFrame, column: str, block_rows: int = BLOCK_ROWS, recall: float = RECALL) -> Model:
    """Learn from all distinct candidates: the network from three fifths of their values, calibration and thresholds from a fifth each."""
    found = scanned.select(F.inline(column)).groupBy("before", "value", "after", "found").agg(F.lit(1).alias("one")).drop("one")
    kept = stored(found.withColumns({"rank": F.xxhash64("value", "before", "after"), "part": F.pmod(F.crc32("value"), F.lit(5))}))
    n = {(r["part"], r["found"]): r["n"] for r in kept.groupBy("part", "found").agg(F.count("*").alias("n")).collect()}
    good, bad = (sum(n.get((k, label), 0) for k in range(3)) for label in (True, False))
    if not (good and bad and (3, True) in n and (3, False) in n and (4, True) in n):
        return Model()
    p = train_blocks(kept.where("part < 3").drop("part"), good, bad, block_rows)

    # context is what the patterns go by: held-out secrets count without it too
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                rows = batch.slice(start, 2048)
                before, value, after = (rows.column(i).to_pylist() for i in range(3))
                none = [""] * len(value)
                kinds = pa.array([alphabet(v) for v in value], pa.string())
                for bare, z in ((False, logits(before, value, after, p)), (True, logits(none, value, none, p))):
                    yield pa.RecordBatch.from_arrays([*rows.columns, kinds, pa.array([bare] * len(value)), pa.array(z)], names=[*rows.schema.names, "kind", "bare", "z"])
    held = kept.where("part >= 3").select("before", "value", "after", "found", "rank", "part")
    schema = T.StructType([*held.schema.fields, T.StructField("kind", T.StringType()), T.StructField("bare", T.BooleanType()), T.StructField("z", T.DoubleType())])
    scored = stored(held.mapInArrow(run, schema))
    slope, shift = calibrate_rows(scored.where("part = 3"))
    model = Model(p, slope, shift)

    def score(z: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30))))
    labelled = scored.where("part = 4 AND found")
    many = [r["kind"] for r in labelled.groupBy("kind").agg(F.count("*").alias("n")).where(F.col("n") >= FEW).collect()]
    model.common = score(_heights(labelled, recall, [])[None])
    if many:
        model.thresholds = {str(k): score(z) for k, z in _heights(labelled.where(F.col("kind").isin(many)), recall, ["kind"]).items()}
    return model


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, block_rows: int = BLOCK_ROWS, recall: float = RECALL) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, default all) with ``secrets``: an array of (kind, start, end, score), and ``n_candidates``.

    Kinds are the patterns ``KINDS`` and ``model``, for candidates that no pattern found and whose score reaches its threshold; ``score`` of a pattern's span is the best of the
    candidates it overlaps, null without one.  Positions are code points, the end exclusive, ordered by start and kind.  Null texts count as empty, repeated rows are rows of their own,
    an empty table gives an empty table, bytes that are no UTF-8 count as one character each.  Where candidates of one label are missing nothing is added.  Texts and
    candidates are read whole, whatever their length.  Columns of ``docs`` named like the new ones are replaced.
    """
    made = ("secrets", "n_candidates")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    spans, found = free(docs, "spans"), free(docs, "found")
    scanned = stored(scan(docs, text, keep, (spans, found)))
    model = fit(scanned, found, block_rows, recall)
    kind = to_arrow_type(SCORED)

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        fixed, open_ = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        flat = [c for row in open_ for c in row]
        scores = list(_scores(flat, model))
        out, at = [], 0
        for own, row in zip(fixed, open_):
            mine = list(zip(row, scores[at:at + len(row)]))
            at += len(row)
            secrets = [{**s, "score": max((x for c, x in mine if x is not None and c["start"] < s["end"] and s["start"] < c["end"]), default=None)} for s in own]
            secrets += [{"kind": MODEL, "start": c["start"], "end": c["end"], "score": x} for c, x in mine
                        if x is not None and not c["found"] and x >= model.thresholds.get(alphabet(c["value"]), model.common)]
            out.append(sorted(secrets, key=lambda s: (s["start"], [*KINDS, MODEL].index(s["kind"]), s["end"])))
        return {"secrets": pa.array(out, type=kind), "n_candidates": pa.array([len(r) for r in open_], pa.int32())}

    return with_columns(scanned, {"secrets": SCORED, "n_candidates": T.IntegerType()}, run, keep, [spans, found])


def _scores(flat: list[dict[str, object]], model: Model, at_once: int = 2048) -> Iterator[float | None]:
    for start in range(0, len(flat), at_once):
        part = flat[start:start + at_once]
        yield from (model.scores([c["before"] for c in part], [c["value"] for c in part], [c["after"] for c in part]).tolist() if model.parameters else [None] * len(part))
