"""Secret scan (operator 5): fixed rules plus a character convolutional network.

The rules find ``assign``, ``access`` and ``hex`` spans.  Every other candidate
(a long run of key characters with a digit or mixed case) is scored with its
surroundings by a small convolutional network in numpy; those above the
threshold are added as ``model`` spans.  The network is trained on labelled
findings: those of the rules against other candidates, every distinct one of
the documents in its whole length.  Each finding is also shown without its
surroundings, so that a bare key is recognised too.  The findings are dealt
over parts by hash; in each epoch every part is one task's pass of Adam from
the common network, and the parts' networks are averaged.  Scores are
calibrated on a quarter of the findings, held out by hash (Platt scaling), and
the threshold is the largest one that keeps ``RECALL`` of the held-out rule
findings, not below ``LEAST``; ``recall`` is the share of them that the
threshold then keeps.

Defined cases: a null or empty text has no spans; with too few findings to
train and calibrate, no span is added; spans of one place are listed once per
kind; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from benchtide.llm.common import code_points, stage, text_of, unstage

# the rules (fixed values)
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
MIN_ASSIGN = 6
# runs below 20 and 24 characters fail; a longer run is matched whole
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# a candidate: a run of key characters of this length or more
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")

LEFT, VALUE, RIGHT = 24, 40, 8
WINDOW = LEFT + VALUE + RIGHT
SYMBOLS = 96  # printable ASCII, then one each for other and none
EMBED, WIDTH, FILTERS, HIDDEN = 8, 5, 24, 16
RECALL, LEAST = 0.98, 0.5
LEAST_FINDINGS = 40
EPOCHS, BATCH = 6, 64
# windows of a part of the training, until there are MAX_PARTS larger ones
PART_WINDOWS, MAX_PARTS = 4096, 64


# ----------------------------------------------------------------- the rules

def rule_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the rules, by start, then kind as listed."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text)
           if len(m.group(2)) >= MIN_ASSIGN]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Long runs of key characters with a digit or both cases inside."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if any(c.isdigit() for c in run) or (run[1:].lower() != run[1:] and run.upper() != run):
            out.append(m.span())
    return out


def windows(text: str, start: int, end: int, bare: bool = False) -> np.ndarray:
    """Symbol rows for a candidate: one, or several where it is longer than
    the value part of a row.  Symbols differ by part (left, value, right)."""
    rows = []
    for at in range(start, end, VALUE):
        stop = min(end, at + VALUE)
        left = "" if bare else text[max(0, at - LEFT):at]
        right = "" if bare else text[stop:stop + RIGHT]
        row = np.full(WINDOW, SYMBOLS - 1, np.int64)
        for part, to in ((left, LEFT - len(left)), (text[at:stop], LEFT), (right, LEFT + VALUE)):
            c = code_points(part).astype(np.int64) - 32
            row[to:to + len(c)] = np.where((c >= 0) & (c < SYMBOLS - 2), c, SYMBOLS - 2)
        row[LEFT:LEFT + VALUE] += SYMBOLS
        row[LEFT + VALUE:] += 2 * SYMBOLS
        rows.append(row)
    return np.array(rows)


# --------------------------------------------------------------- the network

@dataclass
class Network:
    embed: np.ndarray    # (3 * SYMBOLS, EMBED)
    conv: np.ndarray     # (WIDTH * EMBED, FILTERS)
    conv_bias: np.ndarray
    dense: np.ndarray    # (FILTERS, HIDDEN)
    dense_bias: np.ndarray
    out: np.ndarray      # (HIDDEN,)
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> "Network":
        def he(a, b):
            return rng.normal(0, (2.0 / a) ** 0.5, (a, b))
        return cls(rng.normal(0, 0.3, (3 * SYMBOLS, EMBED)), he(WIDTH * EMBED, FILTERS), np.zeros(FILTERS),
                   he(FILTERS, HIDDEN), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1))

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_bias, self.dense, self.dense_bias, self.out, self.out_bias]

    def forward(self, rows: np.ndarray):
        e = self.embed[rows]                                      # n, WINDOW, EMBED
        patches = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1)
        patches = patches.transpose(0, 1, 3, 2).reshape(len(rows), WINDOW - WIDTH + 1, WIDTH * EMBED)
        maps = patches @ self.conv + self.conv_bias
        at = maps.argmax(axis=1)                                  # n, FILTERS
        peak = np.take_along_axis(maps, at[:, None, :], 1)[:, 0]
        pooled = np.maximum(peak, 0)
        hidden = np.maximum(pooled @ self.dense + self.dense_bias, 0)
        return patches, at, peak, pooled, hidden, hidden @ self.out + self.out_bias[0]

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(rows[i:i + 256])[-1] for i in range(0, len(rows), 256)]
                              or [np.empty(0)])

    def gradients(self, rows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        patches, at, peak, pooled, hidden, z = self.forward(rows)
        dz = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(rows)
        dh = np.outer(dz, self.out) * (hidden > 0)
        dp = (dh @ self.dense.T) * (peak > 0)                     # n, FILTERS
        chosen = np.take_along_axis(patches, at[:, :, None], 1)   # n, FILTERS, WIDTH * EMBED
        dconv = np.einsum("nf,nfk->kf", dp, chosen)
        de = np.zeros_like(self.embed)
        back = dp[:, :, None] * self.conv.T[None]                 # n, FILTERS, WIDTH * EMBED
        where = at[:, :, None] + np.arange(WIDTH)
        symbols = np.take_along_axis(rows[:, None, :].repeat(FILTERS, 1), where, 2)
        np.add.at(de, symbols.reshape(-1), back.reshape(-1, EMBED))
        return [de, dconv, dp.sum(0), pooled.T @ dh, dh.sum(0), hidden.T @ dz, np.array([dz.sum()])]


@dataclass
class Learner:
    """A network in training, with the moments of Adam."""
    net: Network
    first: list[np.ndarray]
    second: list[np.ndarray]
    step: float = 0

    @classmethod
    def fresh(cls, seed: int = 5) -> "Learner":
        net = Network.fresh(np.random.default_rng(seed))
        return cls(net, [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()])

    def learn(self, rows: np.ndarray, labels: np.ndarray, share: float) -> None:
        """One step; ``share`` is that of label 1: both classes weigh the same."""
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        self.step += 1
        for p, g, m, v in zip(self.net.params(), self.net.gradients(rows, labels, weight), self.first, self.second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= 0.005 * (m / (1 - 0.9 ** self.step)) / (np.sqrt(v / (1 - 0.999 ** self.step)) + 1e-8)

    def arrays(self) -> list[np.ndarray]:
        return [*self.net.params(), *self.first, *self.second]

    def numbers(self) -> np.ndarray:
        return np.concatenate([[self.step], *(x.reshape(-1) for x in self.arrays())])

    def take(self, numbers: np.ndarray) -> None:
        self.step, at = float(numbers[0]), 1
        for x in self.arrays():
            x[...] = numbers[at:at + x.size].reshape(x.shape)
            at += x.size


@dataclass
class Scanner:
    net: Network
    slope: float
    shift: float
    threshold: float
    recall: float = 1.0

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.net.logits(rows) + self.shift, -30, 30)))


def platt(totals, up: int, down: int) -> np.ndarray:
    """Slope and shift by Newton steps, halved while the loss grows;
    ``totals(slope, shift, high, low)`` gives the loss and the sums of e * z, e,
    v * z * z, v * z and v over the findings, with p the score, e = p - target
    and v = p * (1 - p)."""
    def at(w):
        return totals(*map(float, w), (up + 1) / (up + 2), 1 / (down + 2))

    w = np.array([0.0, np.log((up + 1) / (down + 1))])
    now = at(w)
    for _ in range(30):
        loss, ez, e, vzz, vz, v = now
        step = np.linalg.solve(np.array([[vzz, vz], [vz, v]]) + 1e-4 * np.eye(2), np.array([ez, e]))
        new = at(w - step)
        while new[0] > loss and np.abs(step).max() > 1e-6:
            step /= 2
            new = at(w - step)
        if new[0] > loss:
            break
        w, now = w - step, new
        if np.abs(step).max() < 1e-6:
            break
    return w


def calibrate(net: Network, rows: np.ndarray, labels: np.ndarray) -> Scanner:
    """Platt scaling, then the recall-constrained threshold."""
    z = net.logits(rows)

    def totals(slope, shift, high, low):
        m, target = slope * z + shift, np.where(labels == 1, high, low)
        p = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        loss = np.maximum(m, 0) - target * m + np.log1p(np.exp(-np.abs(m)))
        e, v = p - target, p * (1 - p)
        return loss.sum(), (e * z).sum(), e.sum(), (v * z * z).sum(), (v * z).sum(), v.sum()

    w = platt(totals, labels.sum(), (1 - labels).sum())
    scanner = Scanner(net, float(w[0]), float(w[1]), 1.0)
    found = np.sort(scanner.scores(rows[labels == 1]))
    scanner.threshold = max(LEAST, float(found[int(np.floor((1 - RECALL) * len(found)))]))
    scanner.recall = float((found >= scanner.threshold).mean())
    return scanner


# --------------------------------------------------------------- over tables

_PIECE = pa.struct([("finding", pa.binary()), ("label", pa.int32()), ("at", pa.int32()),
                    ("piece", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def labelled_findings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Values of rule findings (label 1) and other candidates (0), every
    distinct one with its surroundings, as pieces of one window each: finding
    (a digest), label, at (number of the piece), piece, start, end (the value's
    place there) and held_out (a quarter, by hash)."""
    def of(text: str) -> list[dict]:
        spans = rule_spans(text)
        taken = []
        for s, e, kind in spans:
            taken.append((ASSIGN.match(text, s).start(2) if kind == "assign" else s, e, 1))
        taken += [(s, e, 0) for s, e in candidates(text)
                  if not any(s < e2 and s2 < e for s2, e2, _ in spans)]
        out = []
        for s, e, k in taken:
            whole = f"{k}:{min(s, LEFT)}:{e - s}:{text[max(0, s - LEFT):e + RIGHT]}"
            digest = hashlib.blake2b(whole.encode(), digest_size=16).digest()
            for at in range(s, e, VALUE):
                first, stop = max(0, at - LEFT), min(e, at + VALUE)
                out.append({"finding": digest, "label": k, "at": (at - s) // VALUE,
                            "piece": text[first:stop + RIGHT], "start": at - first, "end": stop - first})
        return out

    @F.arrow_udf(from_arrow_type(pa.list_(_PIECE)))
    def findings(texts: pa.Array) -> pa.Array:
        return pa.array([of(t.as_py()) for t in texts], pa.list_(_PIECE))

    return (docs.select(F.explode(findings(text_of(text_col))).alias("f")).select("f.*")
            .dropDuplicates(["finding", "at"])
            .withColumn("held_out", F.pmod(F.xxhash64("finding"), F.lit(4)) == 0))


def _piece_windows(batch: pa.RecordBatch, bare: bool) -> np.ndarray:
    """The windows of a batch of pieces, each followed by its bare one if asked."""
    pieces = zip(*(batch.column(c).to_pylist() for c in ("piece", "start", "end")))
    return np.concatenate([windows(t, s, e, b) for t, s, e in pieces for b in ((False, True) if bare else (False,))])


def train_network(pieces: DataFrame, n_windows: int, share: float, seed: int = 5) -> Network:
    """``EPOCHS`` passes over all pieces, in batches of ``BATCH`` windows."""
    parts = int(np.clip(n_windows // PART_WINDOWS, 1, MAX_PARTS))
    learner = Learner.fresh(seed)
    for epoch in range(EPOCHS):
        shared = pieces.sparkSession.sparkContext.broadcast(learner)

        def learn(batches):
            own = Learner.fresh()
            own.take(shared.value.numbers())
            rows, labels, seen = np.empty((0, WINDOW), np.int64), np.empty(0), 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = np.concatenate([rows, _piece_windows(batch, True)])
                labels = np.concatenate([labels, np.repeat(batch.column("label").to_numpy().astype(float), 2)])
                full = len(rows) // BATCH * BATCH
                for i in range(0, full, BATCH):
                    own.learn(rows[i:i + BATCH], labels[i:i + BATCH], share)
                rows, labels, seen = rows[full:], labels[full:], seen + full
            if len(rows):
                own.learn(rows, labels, share)
                seen += len(rows)
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([seen], pa.int64()), pa.array([own.numbers()], pa.list_(pa.float64()))],
                    ["seen", "numbers"])

        dealt = (pieces.repartition(parts, "finding", "at")
                 .sortWithinPartitions(F.xxhash64("finding", "at", F.lit(epoch)), "finding", "at"))
        got = dealt.mapInArrow(learn, "seen bigint, numbers array<double>").toArrow()
        learner.take(np.average(np.stack([x.values.to_numpy() for x in got.column("numbers")]), axis=0,
                                weights=got.column("seen").to_numpy()))
        shared.unpersist()
    return learner.net


def calibrate_findings(net: Network, pieces: DataFrame) -> Scanner:
    """``calibrate`` over all findings of ``pieces``; the score of a finding is
    the highest of its windows."""
    shared = pieces.sparkSession.sparkContext.broadcast(net)

    def logits(batches):
        for batch in batches:
            if batch.num_rows:
                # surroundings are always there when scanning: calibrate with them
                z = shared.value.logits(_piece_windows(batch, False))
                yield pa.RecordBatch.from_arrays([batch.column("finding"), batch.column("label"), pa.array(z)],
                                                 ["finding", "label", "z"])

    found = stage(pieces.mapInArrow(logits, "finding binary, label int, z double").groupBy("finding", "label")
                  .agg(F.max("z").alias("z"), F.min("z").alias("least")), "op5-logits")
    z, of = F.col("z"), {r["label"]: r["n"] for r in found.groupBy("label").agg(F.count("*").alias("n")).collect()}

    def totals(slope, shift, high, low):
        m, p, target = F.col("m"), F.col("p"), F.col("target")
        near = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), m))
        loss = F.greatest(m, F.lit(0.0)) - target * m + F.log1p(F.exp(-F.abs(m)))
        e, v = p - target, p * (1 - p)
        rows = found.select(z, (z * slope + shift).alias("m"),
                            F.when(F.col("label") == 1, high).otherwise(low).alias("target"))
        return rows.withColumn("p", 1 / (1 + F.exp(-near))).agg(
            *[F.sum(x) for x in (loss, e * z, e, v * z * z, v * z, v)]).first()

    slope, shift = map(float, platt(totals, of.get(1, 0), of.get(0, 0)))
    margins = found.where(F.col("label") == 1).select(
        F.greatest(z * slope + shift, F.col("least") * slope + shift).alias("m"))
    at = margins.orderBy("m").offset(int(np.floor((1 - RECALL) * of[1]))).limit(1).first()["m"]
    scanner = Scanner(net, slope, shift, max(LEAST, float(1 / (1 + np.exp(-np.clip(at, -30, 30))))))
    least = at if scanner.threshold > LEAST else float(np.log(LEAST / (1 - LEAST)))
    scanner.recall = margins.where(F.col("m") >= least).count() / of[1]
    unstage(found)
    return scanner


def train(docs: DataFrame, text_col: str = "text") -> Scanner | None:
    """A scanner fitted on all findings of ``docs``; None with too few."""
    pieces = stage(labelled_findings(docs, text_col), "op5-findings")
    held, whole = F.col("held_out"), F.col("at") == 0
    of = {r["label"]: r for r in pieces.groupBy("label").agg(
        F.count_if(whole).alias("findings"), F.count_if(whole & held).alias("held"),
        F.count_if(~held).alias("windows")).collect()}
    scanner = None
    if len(of) == 2 and all(r["findings"] >= LEAST_FINDINGS and r["held"] and r["windows"] for r in of.values()):
        total = of[0]["windows"] + of[1]["windows"]
        net = train_network(pieces.where(~held), total, float(np.clip(of[1]["windows"] / total, 1e-3, 1 - 1e-3)))
        scanner = calibrate_findings(net, pieces.where(held))
    unstage(pieces)
    return scanner


_SCAN = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                   ("base_sha256", pa.string()), ("spans", pa.string()), ("n_model", pa.int64())])


def listed(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_text(texts: list[str], scanner: Scanner | None) -> list[dict]:
    """Spans of whole texts; the candidates of a batch are scored together."""
    base = [rule_spans(t) for t in texts]
    more: list[list] = [[] for _ in texts]
    if scanner is not None:
        rows, owner = [], []

        def flush():
            if rows:
                score = scanner.scores(np.concatenate(rows))
                at = 0
                for (i, s, e), r in zip(owner, rows):
                    if score[at:at + len(r)].max() >= scanner.threshold:
                        more[i].append((s, e, "model"))
                    at += len(r)
                rows.clear()
                owner.clear()

        for i, text in enumerate(texts):
            for s, e in candidates(text):
                if not any(s < e2 and s2 < e for s2, e2, _ in base[i]):
                    rows.append(windows(text, s, e))
                    owner.append((i, s, e))
                    if len(rows) >= 2048:
                        flush()
        flush()
    out = []
    for own, added in zip(base, more):
        count = [sum(k == kind for _, _, k in own) for kind in KINDS[:3]]
        out.append({"n_assign": count[0], "n_access": count[1], "n_hex": count[2],
                    "base_sha256": hashlib.sha256(listed(own).encode()).hexdigest(),
                    "spans": listed(sorted(own + added, key=lambda s: (s[0], KINDS.index(s[2])))),
                    "n_model": len(added)})
    return out


def scan(docs: DataFrame, scanner: Scanner | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, digest and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    @F.arrow_udf(from_arrow_type(_SCAN))
    def find(texts: pa.Array) -> pa.Array:
        return pa.array(scan_text(texts.to_pylist(), shared.value), _SCAN)

    return (docs.select(F.col(id_col).alias("doc_id"), find(text_of(text_col)).alias("s"))
            .select("doc_id", "s.*"))
