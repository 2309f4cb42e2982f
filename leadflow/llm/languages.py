"""Languages of documents and of the segments of mixed documents (problem 8).

Method: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation
through time on a bounded sample of labelled documents, labels every byte; the probabilities are
pooled by sentence and document. A recurrent step reads ``STRIDE`` bytes and labels each of them.
Labels of the sample may be wrong: after a first fit, sentences whose label the network clearly
contradicts are left out and the network is fitted further. The weights (under 1 MB) are kept beside
the cut points, by a hash of the sample, and go to the tasks; texts never leave theirs.

Case and the letters that keyboards interchange (Persian typed with Arabic letters, and the reverse)
are folded before a text is read, in training as well, so that they cannot tell languages apart.
"""

from __future__ import annotations

import hashlib
import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.durable import names_in, shared_folder
from ..sources.tables import table
from .lookalikes import TO_PERSIAN

#: Bounds of the training sample: documents of each label, sentences taken from each document, and letters
#: of a sentence that is taken. They bound the training alone; every text is labelled whole.
SAMPLE_DOCUMENTS = 2000
SAMPLE_SENTENCES = 4
SAMPLE_LETTERS = 600
#: Slices by hash in which the sample is drawn.
SLICES = 4
#: Network size, bytes read at a step, positions in a batch of sentences.
HIDDEN, STRIDE, BATCH_POSITIONS = 32, 4, 60_000
#: Updates of the first fit and of the second, whatever the size of the sample.
UPDATES = (330, 500)
#: Share of the bytes of a sentence that count as independent evidence, since neighbours say the same.
INDEPENDENT = 0.075
#: Log-odds that a change of language within a text must overcome.
SWITCH = 6.0
#: Words that a sentence needs to count by itself; shorter ones may be names. A text that has no such
#: sentence is judged by all its words.
LEAST_WORDS = 3
#: Sentences whose labels a worker keeps.
CACHE_SENTENCES = 100_000

LANGUAGES = ("fa", "en", "ar", "tr", "de", "ru")
# Codes and names that mean a language; regions after - or _ are dropped first.
NAMES = {
    "fa": "fa fas per pes prs farsi persian فارسی پارسی persisch farsça персидский",
    "en": "en eng english englisch انگلیسی ingilizce английский",
    "ar": "ar ara arb arabic عربی العربية عربي arabisch arapça арабский",
    "tr": "tr tur turkish türkçe turkce ترکی türkisch турецкий",
    "de": "de deu ger german deutsch آلمانی almanca немецкий",
    "ru": "ru rus russian русский روسی russisch rusça",
}
_MEANS = {name: code for code, names in NAMES.items() for name in names.split()}

_SENTENCE = re.compile(r"(?<=[.!?؟…。])[\s]+|\n+")
# Addresses, tags, handles, marks in angle brackets and what has a digit or an underscore say nothing
# of a language.
_NO_WORD = re.compile(r"<[^<>\s]*>|https?://\S+|www\.\S+|[#@]\S+|\S*[\w-]+\.\w{2,}(?:/\S*)?(?=[\s,;:،)]|$)|\S*[\d_]\S*")
_LETTERS = re.compile(r"[^\W\d_]+")
_FOLD = str.maketrans({c: v for c, v in TO_PERSIAN.items() if not v.isdigit()})


def meant_language(label: str | None) -> str | None:
    """The two-letter code that a label means, or None."""
    if not label:
        return None
    text = label.strip().lower()
    return _MEANS.get(text) or _MEANS.get(re.split(r"[-_ (]", text, maxsplit=1)[0])


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


def words_of(sentence: str, least: int = LEAST_WORDS) -> str:
    """The sentence without addresses, tags, handles and numbers; '' if under ``least`` words are left."""
    kept = _NO_WORD.sub(" ", sentence)
    found = [w for w in _LETTERS.findall(kept) if len(w) > 1]
    return " ".join(kept.lower().translate(_FOLD).split()) if len(found) >= least else ""


def _as_steps(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes as [step, text, STRIDE], which steps a text has, and which bytes, both 0 or 1."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    size = np.array([len(r) for r in raw])
    length = max(1, -(-int(size.max()) // STRIDE))
    grid = np.zeros((len(raw), length * STRIDE), np.uint8)
    for i, r in enumerate(raw):
        grid[i, : len(r)] = np.frombuffer(r, np.uint8)
    held = (np.arange(length * STRIDE)[None, :] < size[:, None]).astype(np.float32)
    shaped = lambda x: x.reshape(len(raw), -1, STRIDE).transpose(1, 0, 2)
    held = shaped(held)
    return shaped(grid).astype(np.intp), held.max(2), held


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteNetwork:
    """Two gated recurrent layers, one in each direction, and a softmax for every byte."""

    def __init__(self, classes: int = len(LANGUAGES), hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        h = self.hidden = hidden
        make = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = make(STRIDE, 256, 3 * h, scale=0.15)  # a byte's share of the gates
            self.p[f"u{d}"] = make(h, 2 * h, scale=h**-0.5)
            self.p[f"c{d}"] = make(h, h, scale=h**-0.5)
            self.p[f"b{d}"] = np.zeros(3 * h, np.float32)
        self.p["w"] = make(2 * h, STRIDE * classes, scale=(2 * h) ** -0.5)
        self.p["o"] = np.zeros(STRIDE * classes, np.float32)

    def _direction(self, d: str, steps: np.ndarray, mask: np.ndarray, keep: bool):
        h, (length, count, _) = self.hidden, steps.shape
        x, u, c, b = (self.p[k + d] for k in "xucb")
        state = np.zeros((count, h), u.dtype)
        out = np.empty((length, count, h), u.dtype)
        memory = []
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            s = steps[t]
            a = x[0][s[:, 0]] + b
            for k in range(1, STRIDE):
                a += x[k][s[:, k]]
            gates = _sigmoid(a[:, : 2 * h] + state @ u)
            z, r = gates[:, :h], gates[:, h:]
            fresh = np.tanh(a[:, 2 * h :] + (r * state) @ c)
            m = mask[t][:, None]
            new = state + m * z * (fresh - state)
            if keep:
                memory.append((t, state, z, r, fresh))
            state = out[t] = new
        return out, memory

    def forward(self, steps: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Probabilities as [step, text, STRIDE, class]."""
        f, mf = self._direction("f", steps, mask, keep)
        b, mb = self._direction("b", steps, mask, keep)
        both = np.concatenate([f, b], 2)
        logits = (both @ self.p["w"] + self.p["o"]).reshape(*steps.shape, -1)
        logits -= logits.max(3, keepdims=True)
        probs = np.exp(logits, out=logits)
        probs /= probs.sum(3, keepdims=True)
        return probs, (both, mf, mb)

    def gradients(self, steps, mask, held, target, weight) -> tuple[dict, float]:
        """Backpropagation through time of the weighted cross entropy of every byte."""
        h = self.hidden
        probs, (both, mf, mb) = self.forward(steps, mask, True)
        scale = held * weight[:, :, None] / max(1.0, float(held.sum()))
        rows = np.arange(len(target))
        seen = probs[:, rows, :, target].transpose(1, 0, 2)
        loss = float(-(np.log(seen + 1e-9) * scale).sum())
        d_logits = probs.copy()
        d_logits[:, rows, :, target] -= 1
        d_logits *= scale[:, :, :, None]
        d_logits = d_logits.reshape(*d_logits.shape[:2], -1)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        flat = d_logits.reshape(-1, d_logits.shape[2])
        g["w"], g["o"] = both.reshape(-1, 2 * h).T @ flat, flat.sum(0)
        d_both = d_logits @ self.p["w"].T
        for d, memory, part in (("f", mf, d_both[:, :, :h]), ("b", mb, d_both[:, :, h:])):
            u, c = self.p["u" + d], self.p["c" + d]
            flow = np.zeros((steps.shape[1], h), u.dtype)
            shares, places = [], []
            for t, state, z, r, fresh in reversed(memory):
                flow = flow + part[t]
                m = mask[t][:, None]
                dz = flow * m * (fresh - state) * z * (1 - z)
                df = flow * m * z * (1 - fresh * fresh)
                back = df @ c.T
                dr = back * state * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                g["c" + d] += (r * state).T @ df
                g["u" + d] += state.T @ dzr
                da = np.concatenate([dzr, df], 1)
                shares.append(da)
                places.append(steps[t])
                flow = flow * (1 - m * z) + back * r + dzr @ u.T
            da, at = np.concatenate(shares), np.concatenate(places)
            g["b" + d] += da.sum(0)
            for k in range(STRIDE):
                order = np.argsort(at[:, k], kind="stable")
                byte = at[order, k]
                first = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
                g["x" + d][k][byte[first]] = np.add.reduceat(da[order], first, axis=0)
        return g, loss

    def fit(self, texts: list[str], labels: np.ndarray, updates: int, rate: float = 0.015, batch: int = 128, seed: int = 1) -> None:
        if not texts:
            return
        rng = np.random.default_rng(seed)
        counts = np.bincount(labels, minlength=len(LANGUAGES)).clip(1)
        balance = np.sqrt(counts.max() / counts).astype(np.float32)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        n = 0
        by_length = np.argsort([len(t) for t in texts], kind="stable")
        batches = [by_length[i : i + batch] for i in range(0, len(texts), batch)]
        order: list[int] = []
        while n < updates:
            order = order or rng.permutation(len(batches)).tolist()
            rows = batches[order.pop()]
            steps, mask, held = _as_steps([texts[i] for i in rows])
            g, _ = self.gradients(steps, mask, held, labels[rows], balance[labels[rows]][None, :])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            n += 1
            now = rate * (1 - 0.9 * n / updates)
            for k, v in g.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9))
                first, second = moments[k]
                first += 0.1 * (v - first)
                second += 0.01 * (v * v - second)
                self.p[k] -= now * (first / (1 - 0.9**n)) / (np.sqrt(second / (1 - 0.99**n)) + 1e-6)

    def pooled(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-probabilities over the bytes of each text, and their number."""
        out = np.zeros((len(texts), len(LANGUAGES)), np.float32)
        size = np.zeros(len(texts), np.int64)
        order = np.argsort([len(t.encode("utf-8", "replace")) for t in texts], kind="stable")[::-1]
        at = 0
        while at < len(order):
            longest = max(1, len(texts[order[at]].encode("utf-8", "replace")) // STRIDE)
            rows = order[at : at + max(1, BATCH_POSITIONS // longest)]
            at += len(rows)
            steps, mask, held = _as_steps([texts[i] for i in rows])
            probs, _ = self.forward(steps, mask)
            probs += 1e-6
            logs = np.log(probs, out=probs)
            logs *= held[:, :, :, None]
            n = held.sum((0, 2)).clip(1)
            out[rows] = logs.sum((0, 2)) / n[:, None]
            size[rows] = n
        return out, size


def train(documents: list[tuple[str, str]], seed: int = 7) -> ByteNetwork:
    """Fit on (text, label) pairs of which some labels are wrong and some texts are mixed."""
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for text, label in sorted(set(documents)):
        code = meant_language(label)
        if code is None:
            continue
        known = [w for s in sentences(text) if (w := words_of(s)) and len(w) <= SAMPLE_LETTERS]
        for i in rng.permutation(len(known))[:SAMPLE_SENTENCES]:
            texts.append(known[i])
            labels.append(LANGUAGES.index(code))
    target = np.array(labels, np.intp)
    network = ByteNetwork(seed=seed)
    network.fit(texts, target, UPDATES[0], rate=0.012, seed=seed)
    if texts:
        logs, _ = network.pooled(texts)
        keep = np.flatnonzero(logs[np.arange(len(texts)), target] > logs.max(1) - 0.5)
        network.fit([texts[i] for i in keep], target[keep], UPDATES[1], rate=0.006, seed=seed + 1)
    return network


def kept_network(spark: SparkSession, documents: list[tuple[str, str]]) -> dict:
    """Weights of the network for a sample: read if it was trained before, else trained and kept."""
    size = (HIDDEN, STRIDE, SAMPLE_SENTENCES, SAMPLE_LETTERS, UPDATES)
    sample = hashlib.sha256(repr((size, sorted(set(documents)))).encode("utf-8", "surrogatepass")).hexdigest()[:32]
    path = f"{shared_folder(spark)}/language-network-{sample}"
    if "_SUCCESS" not in names_in(spark, path):
        held = io.BytesIO()
        np.savez(held, **train(documents).p)
        spark.createDataFrame([(held.getvalue(),)], "weights binary").coalesce(1).write.mode("overwrite").parquet(path)
    with np.load(io.BytesIO(spark.read.schema("weights binary").parquet(path).first()[0])) as found:
        return {k: found[k] for k in found.files}


def segments(network: ByteNetwork, texts: list[str], cache: dict | None = None) -> list[list[tuple[int, str, float]]]:
    """For each text its runs of whole sentences in one language: (sentences, code, confidence).

    A text without words has no run. The run boundaries are the best path through the sentences
    under a price for each change.
    """
    cache = {} if cache is None else cache
    split = [[words_of(s) for s in sentences(t)] for t in texts]
    split = [row if any(row) else [words_of(" ".join(t.split()), 1)] for row, t in zip(split, texts, strict=True)]
    wanted = list(dict.fromkeys(w for row in split for w in row if w and w not in cache))
    if len(cache) + len(wanted) > CACHE_SENTENCES:
        cache.clear()
        wanted = list(dict.fromkeys(w for row in split for w in row if w))
    if wanted:
        logs, n = network.pooled(wanted)
        cache.update({w: (logs[i], int(n[i])) for i, w in enumerate(wanted)})
    out = []
    for row in split:
        known = [cache[w] for w in row if w]
        if not known:
            out.append([])
            continue
        score = np.array([m * (n * INDEPENDENT) for m, n in known])
        best, back = score[0].copy(), []
        for line in score[1:]:
            stay, move = best, best.max() - SWITCH
            back.append(np.where(stay >= move, np.arange(len(best)), best.argmax()))
            best = np.maximum(stay, move) + line
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        path.reverse()
        runs, at = [], 0
        for i in range(1, len(path) + 1):
            if i == len(path) or path[i] != path[at]:
                total = np.sum([m * n for m, n in known[at:i]], 0) / sum(n for _, n in known[at:i])
                odds = np.exp(total - total.max())
                runs.append((i - at, LANGUAGES[path[at]], float(odds[path[at]] / odds.sum())))
                at = i
        out.append(runs)
    return out


_LABELS = "id long, label string, seg_no int, lang string, confidence double, segments int"


def label_languages(df: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """``id, label, seg_no, lang, confidence, segments``: seg_no 0 for a text in one language, else 1, 2, ...

    Null, empty and blank texts and texts without words give no row. Repeated ids are texts of their
    own; other columns are ignored; texts of any length are read whole. If no row of the sample has a
    label that means a known language, nothing can be learnt and every text gives no row. ``sample``
    bounds the labelled rows of each language used for training, taken in the order of a hash of id
    and text.
    """
    hashed = df.where(F.length(text_col) > 20).select(
        F.col(text_col).alias("t"), _meant(F.col(lang_col)).alias("l"), F.xxhash64(id_col, text_col).alias("h")).where("l is not null")
    # Spark keeps only the first rows of each label before the shuffle (window group limit), which it does for
    # limits of up to a thousand: hence slices.
    rank = F.row_number().over(Window.partitionBy("l", F.pmod("h", F.lit(SLICES))).orderBy("h"))
    drawn = hashed.withColumn("k", rank).where(F.col("k") <= -(-sample // SLICES)).select("t", "l").collect()
    weights = kept_network(df.sparkSession, [(r.t, r.l) for r in drawn]) if drawn else None

    def run(batches):
        network, cache = ByteNetwork(), {}
        if weights is not None:
            network.p = weights
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, labels = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows = []
                if weights is not None:
                    for i, label, found in zip(ids, labels, segments(network, [t or "" for t in part.column(2).to_pylist()], cache), strict=True):
                        for k, (_, code, confidence) in enumerate(found):
                            rows.append((i, label, k + 1 if len(found) > 1 else 0, code, confidence, len(found)))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "label", "seg_no", "lang", "confidence", "segments"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("label"), F.col(text_col).alias("text")).mapInArrow(run, _LABELS)


def _meant(label: Column) -> Column:
    """``meant_language`` as a column."""
    pairs = F.create_map(*[F.lit(x) for kv in sorted(_MEANS.items()) for x in kv])
    text = F.lower(F.trim(label))
    return F.coalesce(F.try_element_at(pairs, text), F.try_element_at(pairs, F.regexp_extract(text, "^[^-_ (]*", 0)))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    rows = label_languages(table(spark, root, "documents"), "doc_id", "text", "lang")
    wrong = (F.col("seg_no") > 0) | ~F.coalesce(_meant(F.col("label")) == F.col("lang"), F.lit(False))
    return rows.where(wrong).select(F.col("id").alias("doc_id"), F.col("seg_no").cast("long").alias("seg_no"), "lang")


def p8_languages(spark: SparkSession, root: str) -> DataFrame:
    """Every document and segment with its language and confidence."""
    rows = label_languages(table(spark, root, "documents"), "doc_id", "text", "lang")
    return rows.select(F.col("id").alias("doc_id"), F.col("seg_no").cast("long").alias("seg_no"), "lang", F.round("confidence", 4).alias("confidence"))


QUERIES = {"p8_found": p8_found, "p8_languages": p8_languages}
