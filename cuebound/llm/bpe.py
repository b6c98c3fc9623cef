"""Byte-level BPE by last tokens: a word's encoding is that of a shorter prefix plus one token, so a trie of words shares it.

Of all ways to write a byte string as tokens, BPE's is the only one in which each two neighbours, merged on their own,
stay as they are. So the last token of a prefix is the one suffix of it that is a token and is compatible with the last
token of the prefix before it. Words are visited in sorted order, which is the depth-first order of their trie: the
stack holds the last token at each depth, and a word only adds the depths beyond what it shares with the one before. The
trie's upper nodes are kept, so words that come later share with all before them.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable

#: Where the tokenizers' files are unless a caller says otherwise.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: How byte_bpe_50k splits text before its merges: fixed values.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file (lines of base64 bytes and a rank)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


#: Nodes of the trie that are kept, and down to which depth in bytes; what is beyond is computed anew.
NODES, NODE_DEPTH = 500_000, 16


class TrieEncoder:
    """Encodes byte strings by the ranks of a byte-level BPE."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        #: Every string that ends a token: once a suffix is none of these, no longer one is a token.
        self.endings = {token[i:] for token in ranks for i in range(len(token))}
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        #: The last token of each prefix that is kept.
        self._nodes: dict[bytes, bytes] = {}

    def merge(self, word: bytes) -> list[bytes]:
        """Plain BPE of a short string: always merge the neighbours whose union has the smallest rank, leftmost first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: bytes, right: bytes) -> bool:
        """Whether left and right stay two tokens when their union is encoded."""
        pair = (left, right)
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            known = self._pairs[pair] = self.merge(left + right) == [left, right]
        return known

    def encode_sorted(self, words: Iterable[bytes]) -> Iterable[list[int]]:
        """The token ids of each word; words must be sorted, so that shared prefixes are encoded once."""
        ranks, endings, compatible, nodes = self.ranks, self.endings, self.compatible, self._nodes
        if len(nodes) > NODES:
            nodes.clear()
        lasts: list[bytes] = [b""]  # lasts[d]: the last token of the prefix of d bytes
        before = b""
        for word in words:
            shared = 0
            top = min(len(before), len(word), len(lasts) - 1)
            if before[:top] == word[:top]:
                shared = top
            else:
                while before[shared] == word[shared]:
                    shared += 1
            del lasts[shared + 1 :]
            for depth in range(shared + 1, len(word) + 1):
                known = nodes.get(word[:depth]) if depth <= NODE_DEPTH else None
                if known is not None:
                    lasts.append(known)
                    continue
                for start in range(depth - 1, -1, -1):
                    token = word[start:depth]
                    if token not in endings:
                        raise ValueError(f"no token ends {word[:depth]!r}")
                    if token in ranks and (not start or compatible(lasts[start], token)):
                        lasts.append(token)
                        if depth <= NODE_DEPTH:
                            nodes[word[:depth]] = token
                        break
                else:
                    raise ValueError(f"no token ends {word[:depth]!r}")
            ids = []
            depth = len(word)
            while depth:
                token = lasts[depth]
                ids.append(ranks[token])
                depth -= len(token)
            ids.reverse()
            before = word
            yield ids
