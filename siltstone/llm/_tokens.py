"""Exact cached encoding with the public BPE vocabularies.

Byte-pair merges never cross a pre-token, and a pre-token never runs from a
non-space character into a following space. So a text can be cut before
spaces, each piece encoded once per worker by the ``tokenizers`` library and
remembered. The cuts that would not be exact (white space on both sides of the
cut) are found first and such texts go to the library whole; tests compare the
two ways.
"""

from __future__ import annotations

import os
import string
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Unicode white space beside the plain space.
OTHER_SPACE = "".join(map(chr, [*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
MARK = "\x01"
#: A run of these after letters is a pre-token of its own.
PUNCTUATION = string.punctuation
#: Lower-case Latin letters.
LETTERS = "".join(c for c in map(chr, range(0x130)) if c.isalpha() and c.islower())
#: The characters that stand for the bytes of letters beyond ASCII in a byte-level vocabulary: printable bytes for
#: themselves, the others for characters from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = dict(zip([b for b in range(256) if b not in _PRINTABLE], map(chr, range(256, 512)), strict=False))
#: Bytes that a remembered piece takes beside its characters and ids.
PIECE_COST = 180
#: So many pieces' ids are laid out at once.
LAID_OUT = 1 << 16


def vocabulary_path(name: str) -> str:
    """The place of an installed public vocabulary file; only a parameter's default, nothing is copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _strings(column: pa.Array) -> list[str]:
    """``to_pylist`` without an Arrow object for each string."""
    return column.to_numpy(zero_copy_only=False).tolist()


class CachedEncoder:
    """Encodes texts to little-endian uint32 ids, remembering pieces of at most ``max_bytes`` in all.

    For vocabularies that drop white space and lower case. When the memory is
    full, further pieces are encoded but not kept; pieces of over 256
    characters never are.
    """

    def __init__(self, path: str, max_bytes: int = 240 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.room = max_bytes
        self.memory: dict[str, bytes] = {"": b""}
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        assert len(self.mark) == 1
        self.tails: dict[str, bytes] = {}

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of runs of lower-case Latin letters: one pre-token each, which no normaliser changes, so the model alone has them."""
        tokenize, counts, flat = self.tokenizer.model.tokenize, [], []
        for w in words:
            ids = [t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_LETTERS))]
            counts.append(len(ids))
            flat.extend(ids)
        raw, ends = np.array(flat, dtype="<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        return [raw[e - 4 * n : e] for n, e in zip(counts, ends, strict=True)]

    def _learn(self, pieces: pa.Array) -> list[bytes]:
        """Ids of distinct pieces the memory lacks; they enter it while there is room."""
        asked, heads = _strings(pieces), pa.compute.utf8_rtrim(pieces, PUNCTUATION)
        special = pa.compute.match_substring_regex(pieces, rf"<\||{MARK}")
        letters = pa.compute.and_not(pa.compute.match_substring_regex(heads, f"^[{LETTERS}]+$"), special)
        found: list[bytes] = [b""] * len(asked)
        self._with_letters(asked, heads, np.flatnonzero(letters), found)
        for i in np.flatnonzero(special).tolist():
            found[i] = self._direct(asked[i])
        plain = np.flatnonzero(pa.compute.invert(pa.compute.or_(letters, special))).tolist()
        for k in range(0, len(plain), 2000):
            part = plain[k : k + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join([asked[i] for i in part])], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(ids == self.mark[0])
            if len(at) != len(part) - 1:  # never seen; kept so that a surprise costs time, not results
                for i in part:
                    found[i] = self._direct(asked[i])
                continue
            raw = ids.tobytes()
            starts, ends = [0, *((at + 1) * 4).tolist()], [*(at * 4).tolist(), len(raw)]
            for i, s, e in zip(part, starts, ends, strict=True):
                found[i] = raw[s:e]
        self._keep(asked, found)
        return found

    def _with_letters(self, asked: list[str], heads: pa.Array, chosen: np.ndarray, found: list[bytes]) -> None:
        """Fill in the ids of the chosen pieces: letters, and punctuation after them, which is encoded apart."""
        coded = heads.take(pa.array(chosen)).dictionary_encode()
        words = _strings(coded.dictionary)
        ids = list(map(self.memory.get, words))
        if fresh := [w for w, raw in zip(words, ids, strict=True) if raw is None]:
            learned = self._words(fresh)
            self._keep(fresh, learned)
            rest = iter(learned)
            ids = [next(rest) if raw is None else raw for raw in ids]
        for i, k in zip(chosen.tolist(), coded.indices.to_numpy().tolist(), strict=True):
            if len(tail := asked[i][len(words[k]) :]) == 0:
                found[i] = ids[k]
                continue
            if (after := self.tails.get(tail)) is None:
                after = self._direct(tail)
                if len(tail) <= 8 and len(self.tails) < 50_000:
                    self.tails[tail] = after
            found[i] = ids[k] + after

    def _keep(self, pieces: list[str], ids: list[bytes]) -> None:
        """Remember pieces while there is room."""
        if self.room > 0 and pieces:
            before, kept = len(self.memory), zip(pieces, ids, strict=True)
            self.memory.update(kept if max(map(len, pieces)) <= 256 else [x for x in kept if len(x[0]) <= 256])
            self.room -= sum(map(len, pieces)) + sum(map(len, ids)) + PIECE_COST * (len(self.memory) - before)

    def _cuttable(self, text: str) -> str:
        """The text with plain spaces for the usual white space, lower-cased where that changes nothing else."""
        if "Σ" not in text and "İ" not in text and "<|" not in text:
            lower = text.lower()
            if is_normalized("NFC", lower):  # else the library composes before it lowers
                text = lower
        for c in "\n\t\r\x0b\x0c":
            if c in text:
                text = text.replace(c, " ")
        return text

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32 bytes.

        All texts are cut and their distinct pieces found in Arrow, so that the memory is asked once for a piece.
        """
        cut = pa.compute.split_pattern(pa.array(map(self._cuttable, texts), pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        ids = list(map(self.memory.get, _strings(coded.dictionary)))
        if missed := [i for i, raw in enumerate(ids) if raw is None]:
            for i, raw in zip(missed, self._learn(coded.dictionary.take(pa.array(missed))), strict=True):
                ids[i] = raw
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        place, flat, which = np.cumsum(size) - size, np.frombuffer(b"".join(ids), "<u4"), coded.indices.to_numpy()
        laid, stops = [], [np.zeros(1, np.int64)]
        for k in range(0, len(which), LAID_OUT):
            part = which[k : k + LAID_OUT]
            n = size[part]
            ends = np.cumsum(n)
            laid.append(flat[np.repeat(place[part] - (ends - n), n) + np.arange(ends[-1])].tobytes())
            stops.append(ends + stops[-1][-1])
        raw, bounds = b"".join(laid), (np.concatenate(stops)[cut.offsets.to_numpy()] * 4).tolist()
        return [raw[s:e] for s, e in zip(bounds, bounds[1:], strict=False)]


@lru_cache(maxsize=4)
def encoder(path: str) -> CachedEncoder:
    """The worker's encoder for a vocabulary; a reused worker keeps what it has learned."""
    return CachedEncoder(path)


class ByteEncoder:
    """The byte-level vocabulary through its rank file, which holds the same ids.

    ``tiktoken`` merges these ranks several times faster than the other
    library; a text that holds a special token's string or unusual white
    space, where the two cut differently, goes to ``tokenizers`` instead.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(json_path)
        self.doubtful = [c for c in OTHER_SPACE if c not in "\n\t\r"] + ["<|"]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            if any(c in t for c in self.doubtful):
                ids = self.exact.encode(t, add_special_tokens=False).ids
            else:
                ids = self.fast.encode_ordinary(t)
            out.append(np.array(ids, dtype="<u4"))
        return out


@lru_cache(maxsize=2)
def byte_encoder(json_path: str, ranks_path: str) -> ByteEncoder:
    import public_tokenizers

    return ByteEncoder(json_path, ranks_path, public_tokenizers.PATTERN)
