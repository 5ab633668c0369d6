"""A minimal acyclic transducer over byte strings with integer outputs, as flat arrays that can be memory-mapped.

The automaton shares suffixes; outputs are sums along transitions: a state knows how many words end in each branch, so
the output of a word is its rank among all words, which is also its row in the table of token ids.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence

import numpy as np

_MAGIC = b"LDWG0001"
_NAMES = ("edges", "targets", "skips", "final", "starts", "ids")
_TYPES = {"edges": np.int64, "targets": np.int32, "skips": np.int32, "final": np.uint8, "starts": np.int64, "ids": np.int32}


def build(words: Sequence[bytes]) -> dict[str, np.ndarray]:
    """The arrays of the minimal automaton of sorted distinct words, none of them empty."""
    finals, trans = [False], [{}]  # by state under construction
    register: dict[tuple, int] = {}
    path = [0]  # states along the last word

    def freeze(down_to: int, last: bytes) -> None:
        while len(path) - 1 > down_to:
            child = path.pop()
            sig = (finals[child], tuple(trans[child].items()))
            known = register.setdefault(sig, child)
            if known != child:
                trans[path[-1]][last[len(path) - 1]] = known

    last = b""
    for w in words:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        freeze(common, last)
        for ch in w[common:]:
            finals.append(False)
            trans.append({})
            trans[path[-1]][ch] = len(finals) - 1
            path.append(len(finals) - 1)
        finals[path[-1]] = True
        last = w
    freeze(0, last)

    number: dict[int, int] = {0: 0}
    order = [0]
    for s in order:
        for t in trans[s].values():
            if t not in number:
                number[t] = len(order)
                order.append(t)
    ends: dict[int, int] = {}
    stack = [0]
    while stack:  # words that end at or below a state, children first
        s = stack[-1]
        todo = [t for t in trans[s].values() if t not in ends]
        if todo:
            stack += todo
            continue
        ends[s] = finals[s] + sum(ends[t] for t in trans[s].values())
        stack.pop()
    edges, targets, skips = [], [], []
    for s in order:
        before = int(finals[s])
        for ch, t in sorted(trans[s].items()):
            edges.append(number[s] * 256 + ch)
            targets.append(number[t])
            skips.append(before)
            before += ends[t]
    return {
        "edges": np.array(edges, np.int64),
        "targets": np.array(targets, np.int32),
        "skips": np.array(skips, np.int32),
        "final": np.array([finals[s] for s in order], np.uint8),
    }


def compile_lexicon(pairs: Iterable[tuple[bytes, Sequence[int]]]) -> bytes:
    """The file of a transducer from words to id lists; words are distinct and not empty."""
    pairs = sorted(pairs)
    a = build([w for w, _ in pairs])
    a["starts"] = np.concatenate([[0], np.cumsum([len(i) for _, i in pairs])]).astype(np.int64)
    a["ids"] = np.array([x for _, i in pairs for x in i], np.int32)
    head = struct.pack(f"<8s{len(_NAMES)}q", _MAGIC, *[len(a[n]) for n in _NAMES])
    out = [head]
    for n in _NAMES:
        raw = a[n].astype(_TYPES[n]).tobytes()
        out.append(raw + b"\0" * (-len(raw) % 8))
    return b"".join(out)


class Lexicon:
    """A compiled transducer, memory-mapped: all workers of a machine share its pages."""

    def __init__(self, path: str) -> None:
        buf = np.memmap(path, np.uint8, "r")
        size = struct.calcsize(f"<8s{len(_NAMES)}q")
        magic, *lengths = struct.unpack(f"<8s{len(_NAMES)}q", buf[:size].tobytes())
        if magic != _MAGIC:
            raise ValueError(f"{path} is no lexicon")
        at = size
        for name, n in zip(_NAMES, lengths, strict=True):
            width = n * np.dtype(_TYPES[name]).itemsize
            setattr(self, name, buf[at : at + width].view(_TYPES[name]))
            at += width + -width % 8

    def ranks(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The rank of each word text[start:start+length], -1 where the automaton doesn't accept it; all words in step."""
        out = np.full(len(starts), -1, np.int64)
        live, state, rank = np.arange(len(starts)), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        step = 0
        while len(live) and len(self.edges):
            done = lengths[live] == step
            hit = live[done]
            out[hit] = np.where(self.final[state[done]] > 0, rank[done], -1)
            go = ~done
            live, state, rank = live[go], state[go], rank[go]
            key = state * 256 + text[starts[live] + step]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            ok = self.edges[at] == key
            live, at, rank = live[ok], at[ok], rank[ok]
            state, rank = self.targets[at].astype(np.int64), rank + self.skips[at]
            step += 1
        return out
