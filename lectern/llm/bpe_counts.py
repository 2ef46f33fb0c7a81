"""Token counts of byte-level byte-pair encodings, without making the tokens.

A text is cut into pieces by the encoding's pattern. Inside a piece the adjacent pair of lowest rank is merged, again and
again; a heap holds the pairs and a linked list the symbols, so a piece of n bytes takes n log n steps. Its count is its bytes
less the merges done. The work is one narrow pass over the texts: no shuffle, and no state but a bounded table of counts by piece.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import methodcaller

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import bound_batches, table

#: Fixed value: how encodings of this family cut a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside these may be of another class in the tokenizer library, whose Unicode version is older than that of ``regex``.
SETTLED = regex.compile(r"[\x00-ԩ‐-⁯₠-₿←-⇿　-鿿가-힣]*+")
#: Characters of a text that are cut into pieces at a time, and where a text can be cut without cutting a piece.
SPAN, GAP = 1 << 16, re.compile(r"(?<=\S)[ \n]")
#: Most pieces whose counts a task remembers, and the longest such piece.
REMEMBERED, LONG = 1 << 18, 48
#: Bits for a symbol in a pair's number.
BITS = 21


def alphabet() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file: itself where it can be seen, else the next one from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoding:
    """Ranks of a vocabulary's merges, and the special strings that are one token wherever they stand.

    ``path`` names a ``tokenizers`` file of a byte-level encoding that neither normalises nor adds a space; others are refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, pre = file["model"], file["pre_tokenizer"] or {}
        plain = not (model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or file["normalizer"])
        if model.get("type") != "BPE" or not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"not a byte-level byte-pair encoding without normaliser: {path}")
        odd = [t["content"] for t in file["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if odd:
            raise ValueError(f"added tokens that take more than their own text: {odd}")
        self.special = [t["content"] for t in file["added_tokens"]]
        self.pre_tokenizer = json.dumps(pre)
        symbols: dict[str, int] = alphabet()
        self.merges: dict[int, tuple[int, int]] = {}  # pair -> (rank, symbol that it makes)
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made = symbols.setdefault(left + right, len(symbols))
            self.merges[symbols[left] << BITS | symbols[right]] = (rank, made)

    def tokens(self, piece: bytes) -> int:
        """Tokens of one piece: its bytes less the merges done."""
        symbol, ranks = list(piece), self.merges
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], k) for k in range(n - 1) if (r := ranks.get(symbol[k] << BITS | symbol[k + 1]))]
        heapify(heap)
        while heap:
            rank, k = heappop(heap)
            j = after[k]
            # A symbol that was merged into its left neighbour is -1; a pair that has changed has another rank.
            if symbol[k] < 0 or j == len(piece):
                continue
            now = ranks.get(symbol[k] << BITS | symbol[j])
            if now is None or now[0] != rank:
                continue
            symbol[k], symbol[j], n = now[1], -1, n - 1
            after[k] = e = after[j]
            if e < len(piece):
                before[e] = k
                if r := ranks.get(symbol[k] << BITS | symbol[e]):
                    heappush(heap, (r[0], k))
            if (b := before[k]) >= 0 and (r := ranks.get(symbol[b] << BITS | symbol[k])):
                heappush(heap, (r[0], b))
        return n


class Counter(dict):
    """Counts of texts; as a table, the counts of short pieces seen so far."""

    def __init__(self, encoding: Encoding):
        super().__init__()
        self.encoding = encoding
        self.special = re.compile("|".join(map(re.escape, sorted(encoding.special, key=len, reverse=True)))) if encoding.special else None
        self.pieces = regex.compile(PIECES)
        self.library = None

    def __missing__(self, piece: str) -> int:
        n = self.encoding.tokens(piece.encode())
        if len(piece) <= LONG:
            self[piece] = n
        return n

    def cut_by_library(self, text: str) -> Iterator[str]:
        from tokenizers import Tokenizer, models

        if self.library is None:
            self.library = Tokenizer.from_str(json.dumps(json.loads(Tokenizer(models.BPE()).to_str()) | {"pre_tokenizer": json.loads(self.encoding.pre_tokenizer)})).pre_tokenizer
        return (text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text))

    def plain(self, text: str) -> int:
        """Tokens of a text in which special strings mean nothing."""
        n = at = 0
        while at < len(text):
            gap = GAP.search(text, at + SPAN) if len(text) - at > SPAN else None
            part, at = (text[at : gap.start()], gap.start()) if gap else (text[at:] if at else text, len(text))
            if SETTLED.fullmatch(part) is None:
                pieces = self.cut_by_library(part)
            elif len(part) <= 2 * SPAN:
                pieces = self.pieces.findall(part)
            else:
                pieces = map(methodcaller("group"), self.pieces.finditer(part))
            n += sum(map(self.__getitem__, pieces))
            if len(self) > REMEMBERED:
                self.clear()
        return n

    def count(self, text: str) -> int:
        if self.special is None or self.special.search(text) is None:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


def token_count(spark: SparkSession, text: Column, path: str) -> Column:
    """Tokens of ``text`` (null: 0) as the encoding in the file ``path`` of the driver makes them; its merges, of a size that the file fixes, go to every executor."""
    bound_batches(spark)
    encoding = spark.sparkContext.broadcast(Encoding(path))

    @F.arrow_udf("long")
    def counted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(encoding.value)
        for batch in texts:
            yield pa.array([counter.count(t) for t in batch.to_pylist()], pa.int64())

    return counted(F.coalesce(text, F.lit("")))


def with_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    A null text counts as empty and has no token; rows with a null or repeated id are rows like any other; other columns are not
    read, whatever their names; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), token_count(docs.sparkSession, F.col("text"), path).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return with_counts(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
