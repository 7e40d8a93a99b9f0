"""BPE encoding and decoding with a contiguous rank array.

A word is an array of part boundaries beside the ranks of the pairs that adjacent parts would make. The least rank is
found by a scan, its boundary deleted, and the two ranks beside it are refreshed; words are short, so the scans are
cheaper than any index. Words of over SCAN parts (texts without white space) keep the same array but take the minimum
from a heap, with the same result. Encoded words are kept in bounded tables of each Python worker.

The tokenizer file's own rules hold: NFC, white space to one space, lower case code point by code point, its split
pattern, byte-level characters with a word end, and special tokens taken out of the raw text first.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import KEPT_WORDS, Words, documents, held_by, per_text

TOKENIZER = "word_bpe_49k.json"
SCAN, NONE = 256, 1 << 60
#: Unicode's White_Space, which the tokenizer's patterns mean by \s.
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, 0x2000, 0x2D, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Marked fixed value: the split pattern of the tokenizer file, with SPACE spelt out.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself where visible in Latin-1, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class BPE:
    """encode(text) and decode(ids) of a tokenizer file's content. Encoded texts are bytes: 4 for each id, little-endian."""

    def __init__(self, content: str) -> None:
        import regex

        spec = json.loads(content)
        ids: dict[str, int] = spec["model"]["vocab"]
        end = spec["model"].get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.made = [ids[a + b] for a, b in pairs]  # by rank: the id that a merge makes
        self.rank = {ids[a] << 32 | ids[b]: k for k, (a, b) in reversed(list(enumerate(pairs)))}
        alphabet = byte_alphabet()
        self.byte = [ids.get(alphabet[b], -1) for b in range(256)]
        self.last_byte = [ids.get(alphabet[b] + end, -1) for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = {i: t for t, i in (ids | self.special).items()}
        self.tokens = [named.get(i, "") for i in range(max(named) + 1)]
        self.split = regex.compile(SPLIT).findall
        self.space = regex.compile(f"[{SPACE}]+")
        self.odd = regex.compile("[\x1c-\x1f]")  # str.split() takes these for white space
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.mark = next(iter(self.special), "\0")[:2]
        #: Runs of several pieces; pieces, and with them runs of a single piece in ASCII, which nothing changes any more.
        self.chunks, self.pieces = Words(KEPT_WORDS // 2), Words(2 * KEPT_WORDS)

    def merge(self, parts: list[int]) -> list[int]:
        """The ids that remain when the pair of least rank (the first of equals) is merged until no pair has a rank."""
        rank_of, made = self.rank.get, self.made
        rank = [rank_of(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        if len(parts) > SCAN:
            return self._merge_long(parts, rank)
        while rank:
            least = min(rank)
            if least == NONE:
                break
            k = rank.index(least)
            parts[k] = made[least]
            del parts[k + 1], rank[k]  # the boundary goes
            if k < len(rank):
                rank[k] = rank_of(parts[k] << 32 | parts[k + 1], NONE)
            if k:
                rank[k - 1] = rank_of(parts[k - 1] << 32 | parts[k], NONE)
        return parts

    def _merge_long(self, parts: list[int], rank: list[int]) -> list[int]:
        n, gone = len(parts), -1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k, r in enumerate(rank) if r < NONE]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            if rank[k] != r or parts[k] == gone:
                continue
            nxt = after[k]
            parts[k], parts[nxt] = self.made[r], gone
            if nxt < len(rank):
                rank[nxt] = NONE
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
            for at in (k, before[k]):
                if at >= 0 and at < len(rank):
                    rank[at] = self.rank.get(parts[at] << 32 | parts[after[at]], NONE) if after[at] < n else NONE
                    if rank[at] < NONE:
                        heapq.heappush(heap, (rank[at], at))
        return [p for p in parts if p != gone]

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        parts = list(map(self.byte.__getitem__, raw))
        parts[-1] = self.last_byte[raw[-1]]
        ids = [p for p in self.merge(parts) if p >= 0]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space, as it stands in the text."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        chunk = chunk.lower() if "\N{GREEK CAPITAL LETTER SIGMA}" not in chunk else "".join(c.lower() for c in chunk)
        known, out = self.pieces, []
        for piece in [chunk] if chunk.isalpha() and chunk.isascii() else self.split(chunk):
            ids = known.get(piece)
            if ids is None and (ids := known.recall(piece)) is None:
                ids = self._piece(piece)
                if len(piece) <= 64:
                    known.keep(piece, ids)
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def _plain(self, text: str) -> bytes:
        known, single, out = self.chunks, self.pieces, []
        for chunk in text.split() if not self.odd.search(text) else self.space.split(text):
            ids = single.get(chunk) if chunk.isascii() else None
            if ids is None:
                ids = known.get(chunk)
            if ids is None and (ids := known.recall(chunk)) is None:
                ids = self._chunk(chunk)
                if len(chunk) <= 64 and chunk not in single:
                    known.keep(chunk, ids)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if not self.special_at or self.mark not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += self._plain(text[at : m.start()]), struct.pack("<I", self.special[m[0]])
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The file names no decoder: tokens, joined by spaces."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _sha(data) -> str:
    return hashlib.sha256(data).hexdigest()


def _made(content: str) -> BPE:
    """The worker's BPE of a tokenizer file; it goes with its tables when another operator takes the worker's table."""
    return held_by(("bpe", hashlib.sha256(content.encode()).hexdigest()), lambda: BPE(content))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids and decoded, for every row.

    path: a tokenizer file that the driver can read; its content (under 2 MB) is broadcast. A null text is empty and has no
    tokens; texts are encoded whole, however long. Rows are independent: repeated rows and null keys are as any other.
    """
    with open(path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(texts: list[str | None]) -> list[tuple]:
        bpe, out = _made(content.value), []
        for t in texts:
            ids = bpe.encode(t)
            decoded = bpe.decode(ids)
            out.append((len(ids) // 4, _sha(ids), _sha(decoded.encode("utf-8", "surrogatepass")), *((np.frombuffer(ids, "<u4").tolist(), decoded) if with_ids else ())))
        return out

    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return per_text(docs, key, text, run, columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), tokenizer_path(), with_ids=False)
