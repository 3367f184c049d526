"""Merging of byte pairs by rank, and which neighbouring tokens leave each other alone."""

from __future__ import annotations

import base64
import heapq
import json

from cairn.llm.common import Bounded

#: Rank of two parts that never merge.
NEVER = 1 << 62


class Vocabulary:
    """Tokens of a byte-level BPE and the order of its merges.

    ``pairs`` (tokenizers files) lists the merges by their two parts; without it
    (rank files) any two parts merge whose concatenation is a token.
    """

    def __init__(self, ids: dict[bytes, int], pairs: dict[tuple[bytes, bytes], int] | None = None, whole_first: bool = True):
        self.ids, self.pairs, self.whole_first = ids, pairs, whole_first
        self.tokens: dict[int, bytes] = {i: t for t, i in ids.items()}
        self.longest = max(map(len, ids))
        self._apart = Bounded(lambda ab: self.merge(ab[0] + ab[1]) == list(ab), 1 << 20)

    @classmethod
    def from_ranks(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)})

    @classmethod
    def from_json(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        raw = lambda s: bytes(byte_of[c] for c in s)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab = {raw(t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
        return cls(vocab, {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}, whole_first=bool(model.get("ignore_merges")))

    def rank(self, a: bytes, b: bytes) -> int | None:
        return self.ids.get(a + b) if self.pairs is None else self.pairs.get((a, b))

    def merge(self, piece: bytes) -> list[bytes]:
        """Merge by lowest rank, leftmost first, until nothing merges."""
        if len(piece) > 48:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        by_text, get = self.pairs is None, self.ids.get if self.pairs is None else self.pairs.get
        ranks = [get(a + b if by_text else (a, b), NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            here = parts[i] + parts.pop(i + 1)
            parts[i] = here
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + here if by_text else (parts[i - 1], here), NEVER)
            if i < len(ranks):
                ranks[i] = get(here + parts[i + 1] if by_text else (here, parts[i + 1]), NEVER)
        return parts

    def _merge_long(self, piece: bytes) -> list[bytes]:
        """The same with a heap over a linked list."""
        n = len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := self.rank(part[i], part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i] if part[i] is not None else n
            if j >= n or part[i] + part[j] != whole:
                continue
            part[i], part[j], after[i] = whole, None, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := self.rank(whole, part[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, whole + part[after[i]]))
            if (h := before[i]) >= 0 and (r := self.rank(part[h], whole)) is not None:
                heapq.heappush(heap, (r, h, part[h] + whole))
        return [p for p in part if p is not None]

    def apart(self, a: bytes, b: bytes) -> bool:
        """Whether ``a`` and ``b`` side by side stay two tokens.

        A row of tokens is what merging its bytes gives exactly if each two
        neighbours stay apart, for a merge across a border would be made in the
        two neighbours alone as well.
        """
        return self._apart[a, b]
