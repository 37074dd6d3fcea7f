"""Token counts by byte-pair merging over a heap and a linked list."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm.common import Remembered, add_fields, once_per_worker, table

# The pattern that splits text before the merges of the byte-level vocabularies (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer stretches without a break are counted each time they occur instead of being remembered.
REMEMBERED_LENGTH = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable Latin-1, else the next from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class PairMerger:
    """Counts the symbols that are left of a stretch of text after all merges."""

    def __init__(self, merges: list):
        letters = byte_symbols()
        number = {s: b for b, s in enumerate(letters)}

        def symbol(text: str) -> int:
            return number.setdefault(text, len(number))

        # (left, right) -> (rank, merged); symbols are numbered so that pairs hash fast.
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((symbol(left), symbol(right)), (rank, symbol(left + right)))

    def count(self, piece: str) -> int:
        """Initial symbols minus merges: the adjacent pair of lowest rank goes first, the leftmost among equals."""
        symbols = list(piece.encode())
        n = len(symbols)
        if n < 2:
            return n
        ranks = self.ranks
        heap = [
            (known[0], i, pair[0], pair[1], known[1])
            for i, pair in enumerate(zip(symbols, symbols[1:]))
            if (known := ranks.get(pair))
        ]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left_over = n
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = merged, -1
            left_over -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if known := ranks.get((merged, symbols[k])):
                    heapq.heappush(heap, (known[0], i, merged, symbols[k], known[1]))
            h = before[i]
            if h >= 0 and (known := ranks.get((symbols[h], merged))):
                heapq.heappush(heap, (known[0], h, symbols[h], merged, known[1]))
        return left_over


class TokenCounter:
    """Counts tokens of whole texts as the library counts them for a byte-level vocabulary file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        merger = PairMerger(spec["model"]["merges"])
        self.compute = merger.count
        self.remembered = Remembered(merger.count, 1_500_000)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.find = regex.compile(SPLIT).findall
        self.raw, self.library = raw, None

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or not any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self.find(text)
        # Characters newer than the shared Unicode tables: the library alone knows whether it takes them for letters.
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.raw.decode()).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def plain(self, text: str) -> int:
        short, known, compute = REMEMBERED_LENGTH, self.remembered, self.compute
        return sum([known[p] if len(p) <= short else compute(p) for p in self.pieces(text)])

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text.

    ``vocabulary`` is the path of a byte-level ``.json`` file; it is read on the driver and sent along.  Strings of
    added tokens inside a text count one each.  Null and empty texts have 0 tokens; a column called ``into`` is
    replaced; all other columns and repeated rows stay.  A text without any break costs n log n.
    """
    raw = Path(vocabulary).read_bytes()
    key = hashlib.sha256(raw).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(raw)

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        counter = once_per_worker(key, lambda: TokenCounter(sent.value))
        return pa.array([counter.count(t) for t in texts.to_pylist()], pa.int64())

    return add_fields(docs, F.struct(tokens(F.col(text)).alias(into)), [into])


def op1_token_counts(spark: SparkSession, folder: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return count_tokens(docs, vocabulary).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 1024).alias("over_limit"),
    )
