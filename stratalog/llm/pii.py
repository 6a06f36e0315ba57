"""Finding and replacing personal information in free text."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from stratalog.llm.boosting import BoostedTrees
from stratalog.llm.bpe import TOKENIZERS, Vocabulary
from stratalog.llm.pii_candidates import KINDS, MODELS, candidates
from stratalog.llm.pii_text import Batch, Lexicon
from stratalog.llm.pii_training import Writer, usual_words
from stratalog.runtime import in_arrow, spread

#: Texts that the models are trained on, and texts that set the thresholds. Both are written, not taken from the data.
TRAINING_TEXTS, THRESHOLD_TEXTS = 9_000, 3_000
#: Texts that are looked at together, and characters beyond which a batch is closed; a longer text is a batch of its own.
ROWS, CHARACTERS = 2_048, 1_000_000
#: Public vocabularies that tell how usual a word is.
VOCABULARIES = ("byte_bpe_50k", "byte_bpe_multi_50k")


@dataclass
class Detector:
    """Boosted trees and an acceptance threshold for each kind of mention."""

    lexicon: Lexicon
    models: dict[str, BoostedTrees]
    thresholds: dict[str, float]

    @classmethod
    def train(cls, given: list[str | None], brands: list[str | None], texts: int = TRAINING_TEXTS, seed: int = 7, folder: str = TOKENIZERS) -> Detector:
        """Fit on written texts. ``given`` and ``brands`` are small fixed lists, and may be empty."""
        ranks = [Vocabulary.load(os.path.join(folder, f"{v}.tiktoken")).ranks for v in VOCABULARIES]
        lexicon, words, models, thresholds = Lexicon(given, brands, [_words_only(r) for r in ranks]), usual_words(ranks), {}, {}
        lexicon.learn(True)
        fit, pick = _labelled(Writer(seed, given, brands, *words), texts, lexicon), _labelled(Writer(seed + 1, given, brands, *words), THRESHOLD_TEXTS, lexicon)
        for kind in MODELS:
            models[kind] = BoostedTrees().fit(*fit[kind])
            thresholds[kind] = models[kind].threshold(*pick[kind])
        lexicon.learn(False)
        return cls(lexicon, models, thresholds)

    def mentions(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of the mentions of each text, by start; they do not overlap."""
        out: list[list[tuple[str, int, int]]] = []
        for part in _batches(texts):
            out += self._mentions(part)
        return out

    def _mentions(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        batch, good = Batch(texts, self.lexicon), []
        for model, found in candidates(batch).items():
            if len(found.start):
                p = self.models[model].probability(found.features)
                kind = "name" if model == "east" else model
                good += [(int(found.start[i]), int(found.end[i]), kind, round(float(p[i]), 2)) for i in np.flatnonzero(p >= self.thresholds[model])]
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        good.sort()
        at = 0
        while at < len(good):  # one stretch of overlapping candidates after the other
            to, end = at + 1, good[at][1]
            while to < len(good) and good[to][0] < end:
                end = max(end, good[to][1])
                to += 1
            here: list[tuple[int, int]] = []
            # the most probable first, of equals the longer one, then the earlier one
            for a, b, kind, _ in sorted(good[at:to], key=lambda c: (-c[3], c[0] - c[1], c[0], c[2])):
                if all(b <= x or y <= a for x, y in here):
                    here.append((a, b))
                    text = int(np.searchsorted(batch.begins, a, side="right")) - 1
                    first = int(batch.begins[text])
                    out[text].append((kind, a - first, b - first))
            at = to
        return [sorted(m, key=lambda x: x[1]) for m in out]

    def redacted(self, text: str | None, mentions: list[tuple[str, int, int]]) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for kind, start, end in mentions:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
        return "".join([*out, text[at:]])


def _words_only(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """The tokens that are looked up: those that begin with a space, and those beyond ASCII."""
    return {t: i for t, i in ranks.items() if t[:1] == b" " or t[:1] >= b"\xe3"}


def _batches(texts: list[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        if held and (len(held) >= ROWS or size + len(t or "") > CHARACTERS):
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


@lru_cache(4)
def trained(given: tuple[str, ...], brands: tuple[str, ...], folder: str = TOKENIZERS) -> Detector:
    """A detector for these lists, trained once per process."""
    return Detector.train(list(given), list(brands), folder=folder)


def _labelled(writer: Writer, texts: int, lexicon: Lexicon) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Features and labels of the candidates of written texts. E-mail and postal addresses are told by where they begin, as
    what follows, such as a town, may or may not belong to them."""
    rows: dict[str, list] = {k: [] for k in MODELS}
    labels: dict[str, list] = {k: [] for k in MODELS}
    written = [writer.text() for _ in range(texts)]
    for at in range(0, texts, ROWS):
        part = written[at : at + ROWS]
        batch = Batch([t for t, _ in part], lexicon)
        truth = {(k, a + int(batch.begins[i]), b + int(batch.begins[i])) for i, (_, m) in enumerate(part) for k, a, b in m}
        begins = {(k, a) for k, a, _ in truth}
        for model, found in candidates(batch).items():
            kind = "name" if model == "east" else model
            loose = kind in ("email", "address")
            rows[model].append(found.features)
            labels[model] += [float((kind, a) in begins if loose else (kind, a, b) in truth) for a, b in zip(found.start.tolist(), found.end.tolist(), strict=True)]
    return {k: (np.vstack(rows[k]), np.array(labels[k])) for k in MODELS}


_SENT: dict[tuple[str, int], tuple[Detector, Broadcast]] = {}


def _sent(spark: SparkSession, detector: Detector) -> Broadcast:
    """The detector, sent to the workers once per application. Its size does not depend on the data: trees, lists of bounded
    length, and the words of vocabularies of bounded size. A worker keeps it, and what it has learned of words, for all its tasks."""
    key = (spark.sparkContext.applicationId, id(detector))
    if key not in _SENT:
        _SENT[key] = detector, spark.sparkContext.broadcast(detector)
    return _SENT[key][1]


def find(df: DataFrame, detector: Detector, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, kind, first_char)``: one row per mention; no shuffle.

    Null and empty texts have none. Texts are searched whole, whatever their length. Repeated rows are searched each for
    itself, and ids may be null. Other columns are ignored. Offsets count code points.
    """

    sent = _sent(df.sparkSession, detector)

    def run(batches):
        for ids, texts, mentions in _found(batches, sent.value):
            flat = [(i, k, a) for i, one in enumerate(mentions) for k, a, _ in one]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array([f[0] for f in flat], pa.int64())), pa.array([f[1] for f in flat], pa.string()), pa.array([f[2] for f in flat], pa.int64())], ["id", "kind", "first_char"]
            )

    return in_arrow(spread(df.select(df[id].alias("id"), df[text].alias("text"))), run, f"id {dict(df.dtypes)[id]}, kind string, first_char long").toDF(id, "kind", "first_char")


def redact(df: DataFrame, detector: Detector, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, text)`` with each mention replaced by ``[KIND]``; null stays null, all else is unchanged."""

    sent = _sent(df.sparkSession, detector)

    def run(batches):
        for ids, texts, mentions in _found(batches, sent.value):
            yield pa.RecordBatch.from_arrays([ids, pa.array([sent.value.redacted(t, m) for t, m in zip(texts, mentions, strict=True)], pa.string())], ["id", "text"])

    return in_arrow(spread(df.select(df[id].alias("id"), df[text].alias("text"))), run, f"id {dict(df.dtypes)[id]}, text string").toDF(id, "text")


def _found(batches, detector: Detector):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            texts = part.column(1).to_pylist()
            yield part.column(0), texts, detector.mentions(texts)


__all__ = ["KINDS", "Detector", "find", "redact", "trained"]
