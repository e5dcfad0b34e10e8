"""BPE encoding and decoding by speculate and verify.

Units (runs of one class inside words) are independent of each other in this tokenizer,
so each distinct unit of a piece is encoded once and texts are assembled by array
gathers.  For a new word, greedy longest match proposes tokens; a vectorised check
tests whether every adjacent pair could stand side by side in a real encoding;
only words with a failing pair are merged rank by rank.
All three go through thousands of words side by side; words over ``_LONG`` bytes
are taken one by one.  Where ids alone are wanted (op4), new words are merged at once.

Why the pair check suffices: merges run in the order of rank.  Between tokens a
and b the border is crossed exactly if some x on a's right spine and y on b's left
spine have a merge that comes before x and y are merged into their own parents
(on a tie the left merge comes first).

Defined cases: null and empty texts have no ids and an empty decoded text; repeated
rows are encoded each; very long words and texts are taken whole; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, record, table
from tessera.llm.text import Texts, pieces

END = "</w>"
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACES}\p{{L}}\p{{N}}]+")
#: The most distinct units that a worker remembers; beyond, it forgets the later half.
REMEMBER = 250_000

# classes of bytes: 0 space, 1 letter, 2 digit, 3 other, 9 part of a word that is encoded as a whole
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[39] = _KIND[128:] = 9
_WHOLE = np.uint64(0x5851F42D4C957F2D)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: The rank of pairs that are never merged, words that are merged side by side, and the bytes of words that are taken one by one.
_NEVER, _SIDE, _LONG = np.iinfo(np.int64).max, 4096, 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in printable}
    for k, b in enumerate(b for b in range(256) if b not in set(printable)):
        out[chr(256 + k)] = b
    return out


class Lookup:
    """Values of 64-bit keys, found for whole arrays; ``missing`` for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self.missing, self.n = missing, 0
        self._sized(len(keys))
        self.add(keys, values)

    def _sized(self, n: int) -> None:
        bits = max(4, int(4 * n).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.int64), np.full(1 << bits, self.missing)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Takes up new and distinct keys; ``missing`` is no value."""
        self.n += len(keys)
        if 2 * self.n > self.last:
            have = self.values != self.missing
            keys, values = np.concatenate([self.keys[have], keys]), np.concatenate([self.values[have], values])
            self._sized(self.n)
        at = self._slot(keys)
        while len(keys):
            # the first of those that come to a free slot has it, the others go to the next
            slots, first = np.unique(at, return_index=True)
            won = first[self.values[slots] == self.missing]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            keys, values, at = keys[lost], values[lost], (at[lost] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _SPREAD) >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.values.take(at)
        other = np.flatnonzero((self.keys.take(at) != keys) & (out != self.missing))
        while len(other):
            at[other] = (at[other] + 1) & self.last
            out[other] = self.values[at[other]]
            other = other[(self.keys[at[other]] != keys[other]) & (out[other] != self.missing)]
        return out


class Vocabulary:
    """Tokens, merges and the pair check of a word-end BPE file."""

    def __init__(self, spec: dict):
        to_byte = byte_alphabet()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.start = np.zeros(256, np.int64)
        self.end = np.zeros(256, np.int64)
        for c, b in to_byte.items():
            self.start[b], self.end[b] = vocab[c], vocab[c + END]
        n = max(vocab.values()) + 1
        self.left, self.right, self.rank = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        self.n = n
        self.merge: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault(x * n + y, (r, z))
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, r
        keys = np.fromiter(self.merge, np.int64, len(self.merge))
        self.ranks = Lookup(keys, np.array([r for r, _ in self.merge.values()], np.int64), _NEVER)
        # a merge's rank and token in one number, in the order of ranks
        self.merges = Lookup(keys, np.array([r * n + z for r, z in self.merge.values()], np.int64), _NEVER)
        # a token can come up only if its halves can stand side by side until its own merge
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made])]
        fits = self._compatible(self.left[made], self.right[made], self.rank[made])
        ok = np.ones(n, bool)
        for z, f in zip(made.tolist(), fits.tolist(), strict=True):
            ok[z] = f and ok[self.left[z]] and ok[self.right[z]]
        raw = {}
        for s, i in vocab.items():
            if ok[i]:
                last = s.endswith(END) and len(s) > len(END)
                raw[bytes(to_byte[c] for c in (s[: -len(END)] if last else s)), last] = i
        self.inner = {k: i for (k, last), i in raw.items() if not last}
        self.final = {k: i for (k, last), i in raw.items() if last}
        self.longest: dict[int, int] = {}
        for k, _ in raw:
            self.longest[k[0]] = max(self.longest.get(k[0], 1), len(k))
        # the tokens as a tree of bytes: a node's children, and its token inside a word and at a word's end
        child: dict[int, int] = {}
        inner, final = [-1], [-1]
        for (k, last), i in raw.items():
            at = 0
            for c in k:
                at = child.setdefault(at * 256 + c, len(inner))
                if at == len(inner):
                    inner.append(-1)
                    final.append(-1)
            (final if last else inner)[at] = i
        self.child = Lookup(np.fromiter(child, np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child)), -1)
        self.inner_at, self.final_at = np.array(inner), np.array(final)
        self.pairs = _no_keys(-1)

    def _compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int = np.iinfo(np.int64).max) -> np.ndarray:
        """Whether no merge before ``until`` crosses the border between a and b."""
        ok = np.ones(len(a), bool)
        x, up_x = a.copy(), np.broadcast_to(until, a.shape).copy()
        live_x = np.ones(len(a), bool)
        while live_x.any():
            y, up_y, live = b.copy(), np.broadcast_to(until, a.shape).copy(), live_x.copy()
            while live.any():
                r = self.ranks(x * self.n + y)
                # strictly before x is merged to the left; at the latest with y's own merge, of which the border is left
                ok &= ~(live & (r < up_x) & (r <= up_y) & (r < until))
                live &= self.rank[y] >= 0
                up_y = np.where(live, self.rank[y], up_y)
                y = np.where(live, self.left[y], y)
            live_x &= self.rank[x] >= 0
            up_x = np.where(live_x, self.rank[x], up_x)
            x = np.where(live_x, self.right[x], x)
        return ok

    def propose(self, piece: bytes) -> list[int]:
        out, i, n = [], 0, len(piece)
        while i < n:
            m = min(n - i, self.longest.get(piece[i], 1))
            while True:
                tok = (self.final if i + m == n else self.inner).get(piece[i : i + m])
                if tok is not None:
                    break
                m -= 1
            out.append(tok)
            i += m
        return out

    def proposed(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``propose`` of all words ``raw[start:end]``, which go down the tree of tokens side by side; ids, and each word's count."""
        word, p, end = np.arange(len(start)), start.copy(), end.copy()
        node, best, upto = np.zeros(len(start), np.int64), np.full(len(start), -1), start.copy()
        out: list = []
        while len(word):
            node = self.child(node * 256 + raw[p])
            p += 1
            last = p == end
            token = np.where(last, self.final_at[node], self.inner_at[node])
            took = np.flatnonzero((node >= 0) & (token >= 0))
            best[took], upto[took] = token[took], p[took]
            stop = np.flatnonzero((node < 0) | last)
            if len(stop):
                out.append((word[stop], best[stop]))
                p[stop], node[stop], best[stop] = upto[stop], 0, -1
                more = p < end
                if not more.all():
                    word, p, end, node, best, upto = (x[more] for x in (word, p, end, node, best, upto))
        if not out:
            return np.zeros(0, np.int64), np.zeros(len(start), np.int64)
        word, token = (np.concatenate([x[k] for x in out]) for k in (0, 1))
        return token[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(start))

    def merged(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``exact`` of words of about the same length, a merge in each of them at a time; ids, and each word's count."""
        n, size = self.n, end - start
        width = int(size.max())
        place = np.arange(width)
        byte = raw[np.minimum(start[:, None] + place, len(raw) - 1)]
        # cells in a row a word; a cell that was merged into its left neighbour is -1, as are those behind a word
        tok = np.where(place < size[:, None], self.start[byte], -1)
        final = np.arange(len(start)) * width + size - 1
        tok.ravel()[final] = self.end[byte.ravel()[final]]
        near = np.full(tok.shape, _NEVER)
        if width > 1:
            pair = place[1:] < size[:, None]
            near[:, :-1][pair] = self.merges(tok[:, :-1][pair] * n + tok[:, 1:][pair])
        cells, least = tok.ravel(), near.ravel()
        right = np.arange(1, len(cells) + 1)
        left = right - 2
        first, word = np.arange(len(start)) * width, np.arange(len(start))
        while True:
            at = first[word] + near[word].argmin(1)
            merge = least[at]
            go = merge < _NEVER
            word, at, merge = word[go], at[go], merge[go]
            if not len(word):
                break
            gone = right[at]
            behind, before = right[gone], left[at]
            cells[at], cells[gone], least[gone] = merge % n, -1, _NEVER
            right[at] = behind
            has = behind <= final[word]
            left[behind[has]] = at[has]
            least[at] = _NEVER
            a, b = at[has], np.flatnonzero(before >= first[word])
            k = self.merges(np.concatenate([cells[a] * n + cells[behind[has]], cells[before[b]] * n + cells[at[b]]]))
            least[a], least[before[b]] = k[: len(a)], k[len(a) :]
        live = tok >= 0
        return tok[live], live.sum(1)

    def exact(self, piece: bytes) -> list[int]:
        """Merges rank by rank."""
        tok = [int(self.start[b]) for b in piece[:-1]] + [int(self.end[piece[-1]])]
        if len(tok) > _LONG:
            return self._exact_long(tok)
        get, n, none = self.merge.get, self.n, (1 << 40, -1)
        near = [get(tok[i] * n + tok[i + 1], none) for i in range(len(tok) - 1)]
        while near:
            low = min(near)
            if low[1] < 0:
                break
            i = near.index(low)
            tok[i : i + 2] = [low[1]]
            del near[i]
            if i:
                near[i - 1] = get(tok[i - 1] * n + tok[i], none)
            if i < len(near):
                near[i] = get(tok[i] * n + tok[i + 1], none)
        return tok

    def _exact_long(self, tok: list[int]) -> list[int]:
        """The same with a heap, which keeps long pieces near linear."""
        nxt, prv = list(range(1, len(tok) + 1)), list(range(-1, len(tok) - 1))
        heap = [(m[0], i, tok[i], tok[i + 1], m[1]) for i in range(len(tok) - 1) if (m := self.merge.get(tok[i] * self.n + tok[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, z = heapq.heappop(heap)
            j = nxt[i] if tok[i] == a else len(tok)
            if j >= len(tok) or tok[j] != b:
                continue
            tok[i], tok[j] = z, -1
            nxt[i] = nxt[j]
            if nxt[i] < len(tok):
                prv[nxt[i]] = i
            for k in (prv[i], i):
                if k >= 0 and nxt[k] < len(tok) and (m := self.merge.get(tok[k] * self.n + tok[nxt[k]])):
                    heapq.heappush(heap, (m[0], k, tok[k], tok[nxt[k]], m[1]))
        return [t for t in tok if t >= 0]

    def encode(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, guess: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens ``raw[start:end]`` in order, and each one's count; without ``guess`` all are merged."""
        none, size = np.zeros(0, np.int64), np.zeros(len(start), np.int64)
        long = end - start > _LONG
        word = lambda k: raw[start[k] : end[k]].tobytes()
        flat, failed = none, np.arange(len(start))
        if guess:
            short = np.flatnonzero(~long)
            flat, size[short] = self.proposed(raw, start[short], end[short])
            if long.any():
                rows = [self.propose(word(k)) for k in np.flatnonzero(long).tolist()]
                flat, size = replaced(flat, size, np.flatnonzero(long), np.fromiter(chain.from_iterable(rows), np.int64), np.array([len(r) for r in rows]))
            failed = self._failing(flat, size)
        if len(failed):
            # by length, so that rows of cells are full; long words one by one
            failed = failed[np.argsort((end - start)[failed], kind="stable")]
            short = len(failed) - int(long[failed].sum())
            done = [self.merged(raw, start[x], end[x]) for x in (failed[lo : min(lo + _SIDE, short)] for lo in range(0, short, _SIDE))]
            rows = [self.exact(word(k)) for k in failed[short:].tolist()]
            done.append((np.fromiter(chain.from_iterable(rows), np.int64), np.array([len(r) for r in rows], np.int64)))
            flat, size = replaced(flat, size, failed, *(np.concatenate([d[k] for d in done]) for k in (0, 1)))
        return flat, size

    def _failing(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The words with a pair of proposed ids that can't stand side by side."""
        inside = np.ones(max(len(flat) - 1, 0), bool)
        inside[np.cumsum(size)[:-1] - 1] = False
        pairs, inv = np.unique((flat[:-1] * self.n + flat[1:])[inside], return_inverse=True)
        ok = self.pairs(pairs)
        new = np.flatnonzero(ok < 0)
        if len(new):
            ok[new] = self._compatible(pairs[new] // self.n, pairs[new] % self.n)
            if self.pairs.n > 200_000:
                self.pairs = _no_keys(-1)
            else:
                self.pairs.add(pairs[new], ok[new])
        word = np.repeat(np.arange(len(size)), np.maximum(size - 1, 0))
        return np.unique(word[ok[inv] == 0])


def _no_keys(missing: int) -> Lookup:
    return Lookup(np.zeros(0, np.int64), np.zeros(0, np.int64), missing)


def replaced(flat: np.ndarray, size: np.ndarray, words: np.ndarray, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of all words, where ``words`` get ``ids``, ``count`` each."""
    kept = np.ones(len(size), bool)
    kept[words] = False
    kept, own = np.repeat(kept, size), np.repeat(np.arange(len(size)), size)
    size = size.copy()
    size[words] = count
    own = np.concatenate([own[kept], np.repeat(words, count)])
    return np.concatenate([flat[kept], ids])[np.argsort(own, kind="stable")], size


def pre_tokens(word: str) -> list[bytes]:
    norm = unicodedata.normalize("NFC", word)
    norm = norm.lower() if "\u03a3" not in norm else "".join(c.lower() for c in norm)
    return [m.encode() for m in _SPLIT.findall(norm)]


def units(t: Texts, has_special: bool) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts, and of each unit start, end, and whether it is a whole word; document offsets (n + 1).

    ASCII and Latin-1 letters, digits and other ASCII characters are cut by class,
    as normaliser and splitter do.  Words with apostrophes, other characters or
    what may be a special token are units of their own, left as they are.
    """
    buf = t.buf.copy()
    kind = _KIND[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    follow = buf[lead + 1]
    lead, follow = lead[(follow != 0x97) & (follow != 0xB7)], follow[(follow != 0x97) & (follow != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    whole = kind == 9
    if has_special:
        bar = np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124))
        whole[bar] = True
    starts, ends, _ = t.words()
    c = np.concatenate([[0], np.cumsum(whole)])
    odd = np.flatnonzero(c[ends] > c[starts])
    upper = (buf >= 65) & (buf <= 90)
    capital = lead[follow <= 0x9E]
    if len(odd):
        mark = np.zeros(len(buf) + 1, np.int32)
        mark[starts[odd]] += 1
        mark[ends[odd]] -= 1
        inside = np.cumsum(mark[:-1]) > 0
        kind[inside] = 9
        upper &= ~inside
        capital = capital[~inside[capital]]
    buf[upper] += 32
    buf[capital + 1] += 32
    edge = kind == 2
    edge[1:] |= kind[1:] != kind[:-1]
    if len(edge):
        edge[0] = True
        edge[t.offs[t.offs < len(edge)]] = True
    s = np.flatnonzero(edge)
    e = np.append(s[1:], len(kind))[: len(s)]
    keep = kind[s] != 0
    s, e = s[keep], e[keep]
    return Texts(buf, t.offs), s, e, kind[s] == 9, np.searchsorted(s, t.offs)


class Codec:
    """Remembers the ids and decoded bytes of distinct units; with ``ids_only`` nothing decoded, and words are merged without a guess."""

    def __init__(self, vocabulary: Vocabulary, remember: int = REMEMBER, ids_only: bool = False):
        self.v, self.remember, self.ids_only = vocabulary, remember, ids_only
        self.at = _no_keys(0)
        self.ids, self.text = np.zeros(1 << 16, np.uint32), np.zeros(1 << 18, np.uint8)
        self.id_end, self.text_end = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        # every token's text and a space, by id + 1
        said = [(vocabulary.text.get(i, "") + " ").encode() for i in range(max(vocabulary.text) + 1)]
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_end = np.concatenate([[0], np.cumsum([len(x) for x in said])])

    def _plan(self, word: str) -> list:
        """Pre-tokens as bytes and special tokens as ids, in order."""
        if self.special is None or "<|" not in word:
            return pre_tokens(word)
        out: list = []
        for part in self.special.split(word):
            out += [self.v.special[part]] if part in self.v.special else pre_tokens(part)
        return out

    def _put(self, hashes: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        n, used = len(hashes), self.used
        ioffs = np.concatenate([[0], np.cumsum(size)])
        a = int(self.id_end[used])
        self.ids, self.id_end = _grown(self.ids, a + len(flat)), _grown(self.id_end, used + n + 1)
        self.ids[a : a + len(flat)] = flat
        self.id_end[used + 1 : used + n + 1] = a + ioffs[1:]
        if not self.ids_only:
            said, soffs = gather(self.said, self.said_end, flat + 1)
            b = int(self.text_end[used])
            self.text, self.text_end = _grown(self.text, b + len(said)), _grown(self.text_end, used + n + 1)
            self.text[b : b + len(said)] = said
            self.text_end[used + 1 : used + n + 1] = b + soffs[ioffs[1:]]
        self.at.add(hashes, np.arange(used + 1, used + n + 1))
        self.used += n

    def _add(self, hashes: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray, whole: np.ndarray) -> None:
        plain, odd = np.flatnonzero(~whole), np.flatnonzero(whole)
        if len(plain):
            self._put(hashes[plain], *self.v.encode(raw, start[plain], end[plain], not self.ids_only))
        if not len(odd):
            return
        plans = [self._plan(raw[a:z].tobytes().decode("utf-8", "replace")) for a, z in zip(start[odd].tolist(), end[odd].tolist(), strict=True)]
        distinct = list({p: None for plan in plans for p in plan if isinstance(p, bytes)})
        ids: dict = {}
        if distinct:
            ends = np.cumsum(np.fromiter(map(len, distinct), np.int64, len(distinct)))
            flat, size = self.v.encode(np.frombuffer(b"".join(distinct), np.uint8), np.concatenate([[0], ends[:-1]]), ends, not self.ids_only)
            ids = dict(zip(distinct, np.split(flat, np.cumsum(size)[:-1]), strict=True))
        rows = [[i for p in plan for i in (ids[p].tolist() if isinstance(p, bytes) else [p])] for plan in plans]
        size = np.array([len(r) for r in rows])
        self._put(hashes[odd], np.fromiter(chain.from_iterable(rows), np.int64, int(size.sum())), size)

    def rows(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The remembered row of each unit, and each document's first unit (n + 1)."""
        low, starts, ends, whole, offs = units(t, self.special is not None)
        h = low.hashes(starts, ends, lower=False)
        h[whole] ^= _WHOLE
        order = np.argsort(h)
        u = h[order]
        edge = np.ones(len(u), bool)
        edge[1:] = u[1:] != u[:-1]
        u, any_of, inv = u[edge], order[edge], np.empty(len(h), np.int64)
        inv[order] = np.cumsum(edge) - 1
        if self.used + len(u) > self.remember:
            self.used = min(self.used, self.remember // 2)
            kept = (self.at.values > 0) & (self.at.values <= self.used)
            self.at = Lookup(self.at.keys[kept], self.at.values[kept], 0)
        u = u.view(np.int64)
        found = self.at(u)
        new = np.flatnonzero(found == 0)
        for lo in range(0, len(new), 20_000):
            some = new[lo : lo + 20_000]
            part = any_of[some]
            self._add(u[some], low.buf, starts[part], ends[part], whole[part])
            found[some] = self.at(u[some])
        return found[inv], offs


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])


def gather(pool: np.ndarray, end: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pooled values of all rows in order, and where each row's begin (len + 1)."""
    start = end[rows - 1]
    size = end[rows] - start
    offs = np.concatenate([[0], np.cumsum(size)])
    return pool[np.repeat(start - offs[:-1], size) + np.arange(offs[-1])], offs


_codecs: dict[tuple[str, bool], Codec] = {}


def codec(path: str, ids_only: bool = False) -> Codec:
    """One codec a worker, vocabulary file and kind."""
    if (path, ids_only) not in _codecs:
        have = _codecs.get((path, not ids_only))
        _codecs[path, ids_only] = Codec(have.v if have else Vocabulary(json.loads(Path(path).read_text(encoding="utf-8"))), ids_only=ids_only)
    return _codecs[path, ids_only]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns in ``keep``, ``ids array<int>`` and ``decoded`` of every row."""
    return _encoded(docs, path, keep, full=True)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row."""
    return _encoded(docs, path, (), full=False)


def _encoded(docs: DataFrame, path: str | None, keep: tuple[str, ...], full: bool) -> DataFrame:
    path = path or vocabulary_path()
    types = dict(docs.dtypes)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")

    def run(b: pa.RecordBatch):
        c = codec(path)
        for lo, hi, t in pieces(b):
            rows, woffs = c.rows(t)
            ids, ioffs = gather(c.ids, c.id_end, rows)
            text, toffs = gather(c.text, c.text_end, rows)
            io, to = ioffs[woffs].tolist(), toffs[woffs].tolist()
            part = b.slice(lo, hi - lo)
            cols = {"doc_id": part.column("doc_id")} | {k: part.column(k) for k in keep}
            ib, tb = memoryview(ids.astype("<u4").tobytes()), memoryview(text.tobytes())
            # every token is followed by a space; the last one isn't
            said = [tb[a : max(a, z - 1)] for a, z in zip(to[:-1], to[1:], strict=True)]
            if full:
                flat = pa.array(ids.astype(np.int32))
                yield record(**cols, ids=pa.ListArray.from_arrays(pa.array(np.array(io), pa.int32()), flat), decoded=[bytes(s).decode() for s in said])
            else:
                yield record(
                    **cols, n_tokens=np.diff(ioffs[woffs]),
                    ids_sha256=[hashlib.sha256(ib[4 * a : 4 * z]).hexdigest() for a, z in zip(io[:-1], io[1:], strict=True)],
                    decoded_sha256=[hashlib.sha256(s).hexdigest() for s in said],
                )

    more = "ids array<int>, decoded string" if full else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs, run, ", ".join(["doc_id long", *(f"{k} {types[k]}" for k in keep), more]))


def decode(ids: list[int], path: str | None = None) -> str:
    """The text of ids, as the library gives it for a file without a decoder."""
    name = codec(path or vocabulary_path()).v.text
    return " ".join(name[i] for i in ids)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
