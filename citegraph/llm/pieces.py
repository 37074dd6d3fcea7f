"""Piece encoding by unigram Viterbi over a double-array trie, and decoding."""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm.common import Remembered, add_fields, give_back, once_per_worker, table

# The character that marks white space inside pieces (fixed value).
MARKER = "▁"
#: Longer stretches between spaces are segmented each time they occur instead of being remembered.
REMEMBERED_LENGTH = 48


class DoubleArrayTrie:
    """Byte-wise trie: the child of state ``s`` over byte ``b`` is ``t = base[s] + b`` if ``check[t] == s + 1``."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, value in keys.items():
            node = 0
            for byte in key:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                node = children[node][byte]
            ends[node] = value
        size = 4 * len(children) + 512
        base, check, value = np.zeros(size, np.int32), np.zeros(size, np.int32), np.full(size, -1, np.int32)
        free, lowest, place = np.ones(size, bool), 256, {0: 0}
        free[0] = False
        queue = [0]
        for node in queue:
            if not children[node]:
                continue
            labels = np.fromiter(sorted(children[node]), np.int64)
            # The first place from the lowest free slot on where all children fit.
            slots, start = np.empty(0, np.int64), lowest
            while not len(slots):
                slots = start + np.flatnonzero(free[start : start + 512]) - labels[0]
                slots = slots[free[slots[:, None] + labels].all(axis=1)]
                start += 512
            at = int(slots[0])
            base[place[node]] = at
            for byte, child in children[node].items():
                place[child] = at + byte
                free[at + byte], check[at + byte] = False, place[node] + 1
                value[at + byte] = ends.get(child, -1)
                queue.append(child)
            # A stretch that is nearly full is left for good.
            while not free[lowest] or free[lowest : lowest + 256].sum() < 16:
                lowest += 1
        used = int(np.flatnonzero(~free)[-1]) + 257
        self.base, self.check, self.value = base[:used], check[:used], value[:used]

    def lists(self) -> tuple[list, list, list]:
        """The arrays as lists, which plain Python indexes faster."""
        return self.base.tolist(), self.check.tolist(), self.value.tolist()


def read_pieces(path: str) -> dict:
    """Pieces of a model file: ``words`` (id -> bytes), ``logs`` (id -> log score), ``byte`` (byte -> id), the trie.

    A merge model scores a piece by minus its rank; the log score is then minus the log of one plus that rank
    (Zipf's law), which keeps the order.  A unigram model's scores are log probabilities already.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    names, scores = [model.id_to_piece(i) for i in range(size)], [model.get_score(i) for i in range(size)]
    plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ranked = all(scores[i] <= 0 and scores[i] == int(scores[i]) for i in plain)
    logs = [-math.log1p(-s) if ranked and s <= 0 else s for s in scores]
    words = [b""] * size
    for i in plain:
        words[i] = names[i].replace(MARKER, " ").encode()
    byte = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
    for b, i in byte.items():
        words[i] = bytes([b])
    return {
        "words": words,
        "logs": logs,
        "byte": [byte.get(b, model.unk_id()) for b in range(256)],
        "byte_ids": sorted(byte.values()),
        "byte_log": min(logs[i] for i in plain) - 10.0,
        "trie": DoubleArrayTrie({words[i]: i for i in plain}),
        # No piece has a space after another character, so the best path always breaks there.
        "breaks": all(" " not in words[i].decode().lstrip(" ") for i in plain),
    }


class Segmenter:
    """Best segmentation of a stretch of text: the highest sum of log scores."""

    def __init__(self, model: dict):
        self.base, self.check, self.value = model["trie"].lists()
        self.logs, self.byte, self.byte_log = model["logs"], model["byte"], model["byte_log"]
        self.spelled = np.zeros(len(self.logs), bool)
        self.spelled[model["byte_ids"]] = True
        self.scores = np.where(self.spelled, self.byte_log, np.array(self.logs))
        self.chunks = re.compile(" *[^ ]+| +" if model["breaks"] else "(?s).+").findall
        self.remembered = Remembered(self.segment, 300_000)

    def segment(self, text: str) -> bytes:
        """The piece ids as 32-bit numbers.

        Positions are visited in order and a path is replaced only by a better one, so among equal paths the one
        whose last piece is longest stays.  A character that is no piece of its own can always be spelled in bytes.
        """
        data = text.encode()
        n = len(data)
        data += b"\0"
        base, check, value, logs = self.base, self.check, self.value, self.logs
        best: list = [None] * (n + 1)
        back: list = [None] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here is None:
                continue  # inside a character
            lead = data[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            alone, state, j = False, 0, i
            while j < n:
                child = base[state] + data[j]
                if check[child] != state + 1:
                    break
                state = child
                j += 1
                piece = value[state]
                if piece >= 0:
                    alone = alone or j - i == width
                    score = here + logs[piece]
                    if best[j] is None or score > best[j]:
                        best[j], back[j] = score, (i, piece)
            if not alone:
                score, j = here + width * self.byte_log, i + width
                if best[j] is None or score > best[j]:
                    best[j], back[j] = score, (i, -1)
        ids: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            if piece < 0:
                ids.extend(self.byte[b] for b in reversed(data[start:at]))
            else:
                ids.append(piece)
            at = start
        ids.reverse()
        return array("i", ids).tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, float, int]:
        """(ids of the text behind a leading space, their log score, how many stand for single bytes)."""
        if not text:
            return np.empty(0, np.int32), 0.0, 0
        short, known, compute = REMEMBERED_LENGTH, self.remembered, self.segment
        ids = np.frombuffer(
            b"".join([known[c] if len(c) <= short else compute(c) for c in self.chunks(" " + text)]), np.int32
        )
        return ids, float(self.scores[ids].sum()), int(self.spelled[ids].sum())


def _sent(spark: SparkSession, model_path: str) -> tuple[str, object]:
    with open(model_path, "rb") as file:
        key = hashlib.sha256(file.read()).hexdigest()
    model = once_per_worker(("pieces", key), lambda: read_pieces(model_path))
    return key, spark.sparkContext.broadcast(model)


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "piece_ids") -> DataFrame:
    """``docs`` with the piece ids of each whole text, ``log_score`` and ``n_byte_pieces``.

    ``model_path`` names a public piece model; it is read on the driver, the double-array trie is built there and
    sent along.  Null texts have null ids, empty texts none; columns of the same names are replaced, others and
    repeated rows stay.  Work is linear in the text, whatever its length.
    """
    key, sent = _sent(docs.sparkSession, model_path)

    @F.arrow_udf("ids array<int>, score double, in_bytes long")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        segmenter = once_per_worker(("segmenter", key), lambda: Segmenter(sent.value))
        for texts in batches:
            values, counts, scores, in_bytes = [], [], [], []
            give_back(("segmenter", key))
            for scalar in texts:
                text = scalar.as_py()
                part, score, spelled = segmenter.encode(text or "")
                values.append(part)
                counts.append(None if text is None else len(part))
                scores.append(None if text is None else score)
                in_bytes.append(None if text is None else spelled)
            offsets = np.concatenate([[0], np.cumsum([c or 0 for c in counts])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(
                offsets,
                pa.array(np.concatenate([*values, np.empty(0, np.int32)])),
                mask=pa.array([c is None for c in counts], pa.bool_()),
            )
            columns = [lists, pa.array(scores, pa.float64()), pa.array(in_bytes, pa.int64())]
            yield pa.StructArray.from_arrays(columns, ["ids", "score", "in_bytes"])

    encoded = pieces(F.col(text))
    added = F.struct(
        encoded["ids"].alias(ids), encoded["score"].alias("log_score"), encoded["in_bytes"].alias("n_byte_pieces")
    )
    return add_fields(docs, added, [ids, "log_score", "n_byte_pieces"])


def decode(docs: DataFrame, model_path: str, ids: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the text that a list of piece ids stands for.

    Markers become spaces and the leading one goes; byte pieces are joined to characters, ill-formed ones become
    U+FFFD; unknown ids are skipped.  Null ids give null, no ids an empty text.
    """
    key, sent = _sent(docs.sparkSession, model_path)

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = once_per_worker(("words", key), lambda: dict(enumerate(sent.value["words"])))
        for lists in batches:
            give_back(("words", key))
            # Numbers become objects one text at a time.
            offsets, values = lists.offsets.to_pylist(), lists.values.to_numpy(zero_copy_only=False)
            valid = lists.is_valid().to_pylist()
            joined = []
            for present, start, end in zip(valid, offsets, offsets[1:]):
                if not present:
                    joined.append(None)
                    continue
                ids = values[start:end].tolist()
                try:
                    spelled = b"".join(map(words.__getitem__, ids))
                except KeyError:
                    spelled = b"".join([words.get(i, b"") for i in ids])
                text = spelled.decode(errors="replace")
                joined.append(text[1:] if text.startswith(" ") else text)
            yield pa.array(joined, pa.string())

    return add_fields(docs, F.struct(texts(F.col(ids)).alias(into)), [into])


def op9_piece_codec(spark: SparkSession, folder: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    both = decode(encode(docs, model_path), model_path)
    return both.select(
        "doc_id",
        F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"),
        "n_byte_pieces",
        "log_score",
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )
