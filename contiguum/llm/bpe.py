"""Byte-pair encoding and decoding by prefix-sharing trie traversal.

The encoding of a word is fixed by its *last-token states*: for every prefix there is exactly one token that
ends the prefix's encoding, and the encoding of a longer prefix is that of a shorter one plus one token whose
pair with the shorter one's last token is stable under the merges.  A task inserts its distinct words into a
trie and walks it depth first; the states of a shared prefix are computed once for all words below it.

Nothing is shuffled: texts are encoded where they are read, the model (a fixed file) is sent once per worker,
and the word cache of a worker is emptied beyond ``CACHE_CHUNKS`` distinct words (it only saves time).

Operators that only need ids, whatever way they are found, get them from ``tiktoken`` (``RankEncoder``) for the distinct words of some
megabytes of text at a time, and keep no word beyond these.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, lean, small_batches

CACHE_CHUNKS = 500_000
CACHE_PAIRS = 2_000_000
#: Size of the texts whose distinct words are held at once where ids come from ranks.
STRETCH = 6 << 20
#: Unicode White_Space, spelled out as Python's own classes add U+001C-001F (fixed values).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(rest)) for b in range(256)]


class BpeModel:
    """Vocabulary, merges and the stability of token pairs, read from a ``tokenizers`` JSON file.

    Inside, a token is known by its *age*: symbols first, then merged tokens in the order of their merges.
    """

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("only byte-level BPE models without a continuing prefix are supported")
        self.end = end = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        self.names = [t for t in vocab if t not in made] + [a + b for a, b in merges]
        self.age = {t: i for i, t in enumerate(self.names)}
        if len(self.age) != len(self.names):
            raise ValueError("two merges make the same token")
        self.ids = [vocab[t] for t in self.names]
        self.pair = {(self.age[a], self.age[b]): self.age[a + b] for a, b in merges}
        self.parts = [(i, i) for i in range(len(self.names) - len(merges))] + [(self.age[a], self.age[b]) for a, b in merges]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.dtype = np.dtype("<u2") if max(self.tokens) < 1 << 16 else np.dtype("<u4")
        self.raw = {i: np.array([i], self.dtype).tobytes() for i in self.tokens}
        self.seams: dict[int, bool] = {}
        self.whole = [True] * len(self.names)
        for i, (left, right) in enumerate(self.parts):  # parts come before what is made of them
            self.whole[i] = left == i or (self.whole[left] and self.whole[right] and self._apart(left, right, i))

    @functools.cached_property
    def inner(self) -> tuple[dict[str, int], dict[str, tuple[int, ...]]]:
        return self._by_tail("")

    @functools.cached_property
    def final(self) -> tuple[dict[str, int], dict[str, tuple[int, ...]]]:
        return self._by_tail(self.end) if self.end else self.inner

    def _by_tail(self, mark: str) -> tuple[dict[str, int], dict[str, tuple[int, ...]]]:
        """Tokens with (or without) the end-of-word mark whose own text encodes to just them, and the sizes that
        such a token can have at the end of a text, by the text's last characters (up to four), longest first."""
        own: dict[str, int] = {}
        for i, t in enumerate(self.names):
            marked = bool(self.end) and t.endswith(self.end) and len(t) > len(self.end)
            if self.whole[i] and marked == bool(mark):
                own[t[: len(t) - len(mark)]] = i
        sizes: dict[str, set[int]] = {}
        for t in own:
            for n in range(1, min(4, len(t)) + 1):
                sizes.setdefault(t[-n:], set())
            sizes[t[-4:]].add(len(t))
        for key in sorted(sizes, key=len):
            if len(key) > 1:
                sizes[key] |= {n for n in sizes.get(key[1:], ()) if n < len(key)}
        longer: dict[str, set[int]] = {}
        for t in own:
            for n in range(1, min(4, len(t) + 1)):
                longer.setdefault(t[-n:], set()).add(len(t))
        return own, {k: tuple(sorted(v | (longer.get(k, set()) if len(k) < 4 else set()), reverse=True)) for k, v in sizes.items()}

    def _apart(self, left: int, right: int, limit: int) -> bool:
        """Undo merges from both sides of the seam; fail if one older than those undone would cross it."""
        pair, parts = self.pair, self.parts
        while True:
            if pair.get((left, right), limit) < limit:
                return False
            for turn in (left > right, left <= right):
                if turn:
                    limit, nxt = left, parts[left][1]
                    if nxt != left:
                        left = nxt
                        break
                else:
                    limit, nxt = right + 1, parts[right][0]
                    if nxt != right:
                        right = nxt
                        break
            else:
                return True

    def stable(self, left: int, right: int) -> bool:
        """Does the joined text of two tokens encode to exactly these two?  Remembered in ``seams``."""
        if len(self.seams) > CACHE_PAIRS:
            self.seams.clear()
        ok = self.seams[left << 32 | right] = self._apart(left, right, 1 << 62)
        return ok


class TrieEncoder:
    """Distinct words (in byte-alphabet characters) to tokens through one depth-first trie walk."""

    def __init__(self, model: BpeModel):
        self.m = model

    def encode(self, words) -> dict[str, list[int]]:
        """The trie is walked in sorted order: ``states`` holds the last tokens on the path from its root to the current word."""
        m = self.m
        end, names, known, stable, shift = m.end, m.names, m.seams, m.stable, 32
        plain, final = m.inner, m.final
        cut = len(end)
        out: dict[str, list[int]] = {}
        states: list[int] = [-1]
        before = ""
        for word in sorted(words):
            size = len(word)
            inner = size - 1 if end else size
            shared, most = 0, min(len(before), inner)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            for depth in range(shared + 1, inner + 1 + bool(end)):
                tokens, sizes = plain if depth <= inner else final
                near = sizes.get(word[depth - 4 : depth]) if depth > 3 else None
                if near is None:
                    near = sizes.get(word[max(0, depth - 3) : depth]) or sizes.get(word[max(0, depth - 2) : depth]) or sizes[word[depth - 1]]
                for n in near:
                    if n < depth:
                        token = tokens.get(word[depth - n : depth])
                        if token is not None:
                            left = states[depth - n]
                            ok = known.get(left << shift | token)
                            if ok or (ok is None and stable(left, token)):
                                break
                    elif n == depth:
                        token = tokens.get(word[:depth])
                        if token is not None:
                            break
                else:
                    raise KeyError(word[depth - 1])
                states.append(token)
            token = states[size]
            back = [token]
            at = size - len(names[token]) + cut
            while at > 0:
                token = states[at]
                back.append(token)
                at -= len(names[token])
            out[word] = back[::-1]
            before = word[:inner]
            del states[inner + 1 :]
        return out


class RankEncoder:
    """Lists of words to token ids through ``tiktoken``.

    It merges neighbours whose joined bytes are a token, lowest rank first.  That gives the merges of the file if these are listed by id and each token's own
    text encodes to just that token, which is required here.  A blank, which no word holds, stands for the end-of-word mark: a
    word's last byte takes it up first, as those pairs have the lowest ids.
    """

    def __init__(self, model: BpeModel, alphabet: list[str]):
        import tiktoken

        first = len(model.names) - sum(a != i for i, (a, _) in enumerate(model.parts))  # what comes before is not merged
        if not model.end or not all(model.whole) or model.ids[first:] != sorted(model.ids[first:]) or max(model.ids[:first]) > min(model.ids[first:], default=1 << 62):
            raise ValueError("ids of this tokenizer file are not ranks of its merges")
        back, ranks = {c: b for b, c in enumerate(alphabet)}, {}
        self.ends = np.zeros(max(model.ids) + 1, bool)
        for name, i in zip(model.names, model.ids, strict=True):
            marked = name.endswith(model.end) and len(name) > len(model.end)
            ranks[bytes([back[c] for c in (name[: -len(model.end)] if marked else name)]) + b" " * marked] = i
            self.ends[i] = marked
        self.ids = tiktoken.Encoding("own", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def encode(self, lists: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in order, and where each list of words ends."""
        ids = self.ids("".join([f"{' '.join(ws)} " for ws in lists if ws]), disallowed_special=())
        word = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        upto = np.cumsum([len(ws) for ws in lists], dtype=np.int64)
        if len(upto) and upto[-1] != len(word) - 1:
            raise RuntimeError("a word has no end")
        return ids, word[upto]


class TextEncoder:
    """Whole texts to token ids with the normaliser and word splitter that the tokenizer file describes.

    A text is cut at white space; what stands between (a *chunk*) always encodes alike, so chunks are
    looked up, and only new ones are split into words and encoded.
    """

    def __init__(self, spec: dict):
        self.model = BpeModel(spec)
        self.trie = TrieEncoder(self.model)
        self.alphabet = byte_alphabet()
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = [p for p in spec["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"]
        if kinds != ["NFC", "Replace", "Lowercase"] or len(split) != 1 or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError("this tokenizer file has a normaliser, splitter or decoder that is not supported")
        self.words = regex.compile(split[0]["pattern"]["Regex"].replace("\\s", SPACE)).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.model.added)) + ")") if self.model.added else None
        self.odd = re.compile("[\x1c-\x1f]").search
        self.space = re.compile(f"[{SPACE}]+").split
        self.gap = re.compile(f"[{SPACE}]").search
        self.known: dict[str, dict] = {}
        self.fresh: dict[str, dict] = {}

    @functools.cached_property
    def ranks(self) -> RankEncoder:
        return RankEncoder(self.model, self.alphabet)

    def split(self, text: str) -> list[str]:
        """Chunks of a text in order; an added token is a chunk of its own, marked by a leading blank."""
        if self.special is not None and "<" in text and self.special.search(text):
            out = []
            for part in self.special.split(text):
                out += [" " + part] if part in self.model.added else self._plain(part)
            return out
        return self._plain(text)

    @staticmethod
    def _normal(text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower-cased letter by letter: no final sigma
        return text.lower()

    def _plain(self, text: str) -> list[str]:
        text = self._normal(text)
        return [c for c in self.space(text) if c] if self.odd(text) else text.split()

    def _tokens(self, chunks: list[str]) -> list[list[int]]:
        """Token ids of chunks."""
        words, added, ids, alphabet = self.words, self.model.added, self.model.ids, self.alphabet
        parts = [(c,) if c.isalpha() else None if c[0] == " " else words(c) for c in chunks]  # letters alone are one word
        spelled = {w: w if w.isascii() and w.isprintable() else "".join([alphabet[b] for b in w.encode()]) for ws in parts if ws for w in ws}
        tokens = self.trie.encode(set(spelled.values()))
        return [[added[c[1:]]] if ws is None else [ids[t] for w in ws for t in tokens[spelled[w]]] for c, ws in zip(chunks, parts, strict=True)]

    def _raw(self, chunks: list[str]) -> list[bytes]:
        """Token ids of chunks, as bytes."""
        ids, ends = self._by_ranks([() if c[0] == " " else c for c in chunks])
        blob, ends = ids.tobytes(), (ends * ids.itemsize).tolist()
        return [self.model.raw[self.model.added[c[1:]]] if c[0] == " " else blob[a:b] for c, a, b in zip(chunks, [0, *ends[:-1]], ends, strict=True)]

    def _by_ranks(self, chunks: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in order, and where those of each end; some chunks at a time are split into words."""
        words, dtype, step = self.words, self.model.dtype, 1 << 16
        ids, ends, done = [np.zeros(0, dtype)], [np.zeros(0, np.int64)], 0
        for at in range(0, len(chunks), step):
            some, upto = self.ranks.encode([() if not c else (c,) if c.isalpha() else words(c) for c in chunks[at : at + step]])
            ids.append(some.astype(dtype))
            ends.append(upto + done)
            done += len(some)
        return np.concatenate(ids), np.concatenate(ends)

    def learn(self, chunks: set[str], form: str = "ids") -> dict:
        """A table with (at least) these chunks in the form asked for: ``ids`` as bytes, or ``shown`` (decimal ids, tokens).

        Chunks met in two calls move to the lasting table; the others' table is emptied when it is full.
        """
        known, fresh = self.known.setdefault(form, {}), self.fresh.setdefault(form, {})
        rest = [c for c in chunks if c not in known]
        new = [c for c in rest if c not in fresh]
        again = {c: fresh.pop(c) for c in rest if c in fresh}
        if len(known) + len(again) > CACHE_CHUNKS:
            known.clear()
            known.update(again)
            new = [c for c in chunks if c not in known]
        else:
            known.update(again)
        if not new:
            return known
        if form == "ids":
            made = self._raw(new)
        else:
            names = self.model.tokens
            made = [(" ".join(map(str, g)), " ".join([names[i] for i in g])) for g in self._tokens(new)]
        if len(fresh) + len(new) > CACHE_CHUNKS // 2:
            fresh.clear()
        fresh.update(zip(new, made, strict=True))
        return {c: known[c] if c in known else fresh[c] if c in fresh else again[c] for c in chunks}

    def _laid(self, texts: list[str]) -> list[np.ndarray]:
        """Each distinct chunk of these texts is encoded once, and its ids are laid out wherever it stands."""
        chunks = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        seen = chunks.flatten().dictionary_encode()
        ids, ends = self._by_ranks(seen.dictionary.to_pylist())
        laid = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids)).take(seen.indices)
        at = laid.offsets.to_numpy()[chunks.offsets.to_numpy()].tolist()
        ids = laid.flatten().to_numpy()
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        """Texts with added tokens, or with what only Arrow takes for white space (U+001C-001F), go another way."""
        rare = [bool(self.odd(t) or ("<" in t and self.special is not None and self.special.search(t))) for t in texts]
        found = iter(self._laid([self._normal(t) for t, r in zip(texts, rare, strict=True) if not r]))
        return [np.frombuffer(b"".join(self._raw(self.split(t))), self.model.dtype) if r else next(found) for t, r in zip(texts, rare, strict=True)]

    def stretches(self, text: str) -> list[str]:
        """A text cut before white space, which no word and no added token crosses, into stretches of about ``STRETCH`` characters."""
        cuts = [0]
        while len(text) - cuts[-1] > STRETCH and (m := self.gap(text, cuts[-1] + STRETCH)):
            cuts.append(m.start())
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each whole text, by ranks: of one text of any length, or of texts that hold about ``STRETCH`` together.  No word outlasts the call."""
        return self._some(texts) if len(texts) != 1 else [np.concatenate([self._some([s])[0] for s in self.stretches(texts[0])])]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """Token strings joined by a blank: what a tokenizer without a decoder step returns."""
        return " ".join([self.model.tokens[int(i)] for i in ids])


#: Bytes of text whose new words go through the trie together: more words share more prefixes.
TRIE_BYTES = 14 << 20
_ENCODERS: dict[str, TextEncoder] = {}


def uncollected(run):
    """A task's function during which the cycle collector rests: nothing here makes cycles, and collections walk the whole cache."""

    def task(batches):
        was = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.freeze()  # the cache stays; later collections need not walk it
            if was:
                gc.enable()

    return lean(task, keep="bpe")


def encoder(blob: bytes) -> TextEncoder:
    """One encoder for each Python worker and tokenizer file."""
    key = hashlib.sha256(blob).hexdigest()
    if key not in _ENCODERS:
        hold("bpe", _ENCODERS.clear)
        _ENCODERS[key] = TextEncoder(json.loads(blob))
    return _ENCODERS[key]


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def bpe_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again, and return counts and digests of both.

    ``tokenizer`` is the path of the vocabulary file on the driver.  A null text counts as empty: 0 tokens,
    digests of the empty string.  Rows are independent: repeated rows and null ids come back as they are;
    other columns are not read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(load(tokenizer))

    def run(batches):
        enc = encoder(model.value)
        for batch in small_batches(batches, "text", TRIE_BYTES):
            split = [enc.split(t) if t else [] for t in batch.column(1).to_pylist()]
            shown, n, ids, back = enc.learn(set().union(*split), "shown"), [], [], []
            for words in split:
                got = [shown[w] for w in words]
                listed = " ".join([g[0] for g in got])
                n.append(listed.count(" ") + 1 if got else 0)
                ids.append(hashlib.sha256(listed.encode()).hexdigest())
                back.append(hashlib.sha256(" ".join([g[1] for g in got]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(uncollected(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
