"""Cutting a text into units that a byte-level BPE tokenizer encodes independently.

A space between two characters that are not white space always starts a new
pre-token, so the text may be cut before each such space: every unit keeps its
leading space, and the ids of a text are the ids of its units in order.  Where
the tokenizer parts its text by the pattern of byte-level BPE (``parts_finely``),
units are cut before a line break and before a punctuation mark after a letter as
well, so that fewer of them differ.  No Spark code here: these functions run in
Python workers.
"""

from __future__ import annotations

import re

#: White space in any Unicode version the tokenizer may follow (fixed values).
_BLANK = r"\s\x1c-\x1f\x85\xa0 ᠎ -​    　﻿"
_ODD = re.compile(rf"[{_BLANK.replace(chr(92) + 's', chr(92) + 't' + chr(92) + 'r' + chr(92) + 'x0b' + chr(92) + 'x0c')}]")
_SAFE = re.compile(rf"(?<=[^{_BLANK}]) (?=[^{_BLANK}])")
_EDGE = frozenset(" \n")
#: Marks a unit that has no leading space of its own, as the first of a text.
FIRST = "  "
#: After a letter that is one in any Unicode version, before a mark that is no apostrophe (fixed values).
_MARK = re.compile(r"(?<=[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff])(?=[!-&(-/:-@\[-`{-~])")


def _parted_by_spaces(text: str) -> bool:
    return not ("  " in text or "\n " in text or " \n" in text or _ODD.search(text))


def split_units(text: str, fine: bool = False) -> list[str]:
    """Unit keys of a text in order: the first is ``FIRST + piece``, each other
    stands for ``" " + piece``.  No later piece starts with a space, so keys
    are unambiguous.  With ``fine``, a key that starts with a line break stands for
    itself (no text of two blanks in a row is cut so)."""
    if not _parted_by_spaces(text):
        units = _SAFE.split(text)
    elif fine and "\n" in text and "\n\n" not in text:
        units = text.replace("\n", " \n").split(" ")
    else:
        units = text.split(" ")
    units[0] = FIRST + units[0]
    return units


def fine_parts(key: str) -> list[str]:
    """Keys of the parts of a unit before and from each mark after a letter."""
    if key.isalnum() or "<|" in key:
        return [key]
    first, *rest = _MARK.split(key)
    return [first, *(FIRST + x for x in rest)]


def parts_finely(tok) -> bool:
    """Whether the tokenizer parts text by the usual pattern of byte-level BPE alone: letters, digits, marks and line
    breaks apart, and the special tokens hold no place where units are cut."""
    import json

    said = json.loads(tok.to_str())
    how = said["pre_tokenizer"] or {}
    return (said["normalizer"] is None and how.get("type") == "ByteLevel" and bool(how.get("use_regex", True)) and not how.get("add_prefix_space")
            and all(x["content"].startswith("<|") and not re.search(r"\s", x["content"]) and not x["lstrip"] and not x["rstrip"] for x in said["added_tokens"]))


def unit_text(key: str) -> str:
    return key[len(FIRST):] if key.startswith(FIRST) else key if key.startswith("\n") else " " + key


def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


#: Longer runs cost the tokenizer more a word.
_RUN = 24


def encode_units(tok, keys: list[str], piece_bytes=None) -> list[bytes]:
    """Ids of each unit as little-endian unsigned 32-bit integers.

    Units with one space or line break before, and no white space at their ends, are encoded in runs, as
    one text; byte counts of the pieces (``piece_bytes``, by id) show where
    each unit ends.  Where an end does not fall between two ids, and for all
    other units, each is encoded alone."""
    import numpy as np

    out: list = [None] * len(keys)
    if piece_bytes is not None:
        odd = set(filter(_ODD.search, keys)) if _ODD.search("x".join(keys)) else ()
        plain = [i for i, k in enumerate(keys) if k and (k[0] not in _EDGE or k[0] == "\n" and k[1:2].strip()) and k[-1] not in _EDGE and k not in odd]
        shown = [keys[i] if keys[i][0] == "\n" else " " + keys[i] for i in plain]
        sizes = np.fromiter(map(len, map(str.encode, shown)), np.int64, len(shown))
        got = tok.encode_batch_fast(["".join(shown[i:i + _RUN]) for i in range(0, len(shown), _RUN)], add_special_tokens=False)
        ids = [np.array(x.ids, "<u4") for x in got]
        del got
        whole = np.concatenate([np.empty(0, "<u4"), *ids])
        ends, want = np.cumsum(piece_bytes[whole]), np.cumsum(sizes)
        at = np.searchsorted(ends, want)
        if len(whole) and ends[-1] == want[-1] and (ends[at] == want).all():
            runs = [(plain, whole, at)]
        else:       # run by run
            runs = []
            for i, x in zip(range(0, len(plain), _RUN), ids, strict=True):
                ends, want = np.cumsum(piece_bytes[x]), np.cumsum(sizes[i:i + _RUN])
                at = np.searchsorted(ends, want)
                if len(x) and ends[-1] == want[-1] and (ends[at] == want).all():
                    runs.append((plain[i:i + _RUN], x, at))
        for run, x, at in runs:
            raw, start = x.tobytes(), 0
            for i, stop in zip(run, ((at + 1) * 4).tolist(), strict=True):
                out[i] = raw[start:stop]
                start = stop
    alone = [i for i, x in enumerate(out) if x is None]
    for i, e in zip(alone, tok.encode_batch_fast([unit_text(keys[i]) for i in alone], add_special_tokens=False), strict=True):
        out[i] = np.array(e.ids, "<u4").tobytes()
    return out


def piece_table(tok) -> list[bytes]:
    """Bytes of each id of a byte-level tokenizer; special tokens as written."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    out = [b""] * (max(tok.get_vocab(with_added_tokens=True).values(), default=-1) + 1)
    for piece, i in tok.get_vocab(with_added_tokens=True).items():
        known = all(c in byte_of for c in piece)
        out[i] = bytes(byte_of[c] for c in piece) if known else piece.encode()
    return out


def blocks(batch, rows: int = 4096, chars: int = 1 << 23):
    """(ids, texts) of the rows of a batch (doc_id, text), some at a time: at most
    ``rows``, and no more once they hold ``chars``."""
    ids, texts, held = [], [], 0
    for at in range(0, batch.num_rows, 64):
        part = batch.slice(at, 64)
        for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            held += len(t)
            if len(ids) == rows or held >= chars:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


class Encoder:
    """Ids of whole texts in a worker: by the Arrow table ``hot`` (word, ids), then by the
    block's own table of the words that it lacks, each encoded once."""

    def __init__(self, path: str, hot=None, block_words: int = 300_000):
        import numpy as np

        self.tok, self.hot, self.own, self.most = load_tokenizer(path), hot, {}, block_words
        self.sizes, self.fine = np.array([len(x) for x in piece_table(self.tok)]), parts_finely(self.tok)

    def _of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct units."""
        own = self.own
        if len(own) > self.most:
            own.clear()
        found = self._known(words)
        lacking = [i for i, x in enumerate(found) if x is None]
        fresh, parted = {}, {}
        for w in [words[i] for i in lacking]:
            parts = fine_parts(w) if self.fine and not w.isalnum() else ()
            if len(parts) > 1:
                parted[w] = parts
                for p in parts:
                    if p not in own:
                        fresh[p] = None
            else:
                fresh[w] = None
        fresh = list(fresh)
        if parted:
            hot = self._known(fresh)
            own.update((w, x) for w, x in zip(fresh, hot, strict=True) if x is not None)
            fresh = [w for w, x in zip(fresh, hot, strict=True) if x is None]
        own.update(zip(fresh, encode_units(self.tok, fresh, self.sizes), strict=True))
        for w, parts in parted.items():
            own[w] = b"".join([own[p] for p in parts])
        for i in lacking:
            found[i] = own[words[i]]
        return found

    def _known(self, words: list[str]) -> list:
        """Ids of the words that a table holds, else None."""
        found = list(map(self.own.get, words))
        if self.hot is not None and self.hot.num_rows:
            import pyarrow as pa
            import pyarrow.compute as pc

            lacking = [i for i, x in enumerate(found) if x is None]
            at = pc.index_in(pa.array([words[i] for i in lacking], pa.string()), value_set=self.hot.column(0))
            for i, x in zip(lacking, self.hot.column(1).take(at).to_pylist(), strict=True):
                found[i] = x
        return found

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text.  Units are told apart in Arrow: only those that differ become objects."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        plain, ends, other, order = [], [], [], []
        for t in texts:
            if _parted_by_spaces(t):
                order.append(len(plain))
                plain.append(t.replace("\n", " \n") if self.fine and "\n\n" not in t else t)
            else:
                order.append(-1 - len(ends))
                other += split_units(t, self.fine)
                ends.append(len(other))
        lists = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        starts = lists.offsets.to_numpy()
        values = pc.dictionary_encode(lists.flatten())
        words = values.dictionary.to_pylist()
        index = np.empty(len(values) + len(other), np.int64)
        index[:len(values)] = values.indices.to_numpy()
        # First units of texts and the units of other texts follow the distinct ones.
        index[starts[:-1] - starts[0]] = np.arange(len(words), len(words) + len(plain))
        place = dict.fromkeys(other)
        place = dict(zip(place, range(len(words) + len(plain), len(words) + len(plain) + len(place)), strict=True))
        index[len(values):] = list(map(place.__getitem__, other))
        found = pa.array(self._of([*words, *(FIRST + t.split(" ", 1)[0] for t in plain), *place]), pa.large_binary()).take(pa.array(index))
        _, at, raw = found.buffers()
        at = np.frombuffer(at, np.int64)[found.offset:found.offset + len(found) + 1]
        raw = memoryview(raw) if raw is not None else b""
        first = at[starts - starts[0]].tolist()
        later = at[len(values) + np.array([0, *ends])].tolist()
        return [bytes(raw[first[i]:first[i + 1]] if i >= 0 else raw[later[-1 - i]:later[-i]]) for i in order]
