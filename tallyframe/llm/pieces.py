"""Token ids of texts, by way of a memo of the pieces that a vocabulary never merges across.

A piece ends before a space or a new line that follows a character which is not white space, and
between an ASCII letter and ASCII punctuation. There byte-level vocabularies start a match of their
pattern, and word vocabularies a word or a sign, so the ids of a text are the ids of its pieces in
turn. The pieces of a batch are found with numpy and folded to distinct ones by Arrow; of those most
recur, and are looked up.

Where the strings of added tokens count, each is a piece of its own, and what lies between them is cut
as if it were a text, which is what the library does.

A vocabulary that lower-cases and drops white space gives pieces of ASCII and Latin-1 letters the same ids
in lower case and without the space before them; they are looked up so, and words go to its model at once.
So do words of a byte-level vocabulary, with the space before them, since its pattern takes them as one match.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers, and their bytes with all that belongs to them. The longest that it does.
MEMO, MEMO_BYTES = 1 << 19, 16 << 20
LONGEST = 32
#: Bytes of text that are cut at once.
CHUNK = 4 << 20
#: Pieces that are encoded in one call.
TOGETHER = 64

SPACE, LINE = 0x20, 0x0A
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


#: What a vocabulary does before its model sees a word, where pieces of ASCII and Latin-1 letters may be folded.
FOLDING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
#: What a byte-level vocabulary does before its model sees a word, where letters and a space before them are one word.
BYTE_LEVEL = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_SPACED = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
_SPELLED = re.compile(r"[ A-Za-z\xc0-\xff]*").fullmatch


def starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where pieces begin in the joint UTF-8 of several texts, which begin at ``texts``.

    The character before a cut at white space must surely not be white space: it is a visible ASCII
    character, or one of two bytes of which the first is C3 to DF. White space outside ASCII begins
    with other bytes.
    """
    at = np.flatnonzero((data == SPACE) | (data == LINE))
    at = at[at > 1]
    before, lead = data[at - 1], data[at - 2]
    sure = (before > SPACE) & (before < 0x7F) | (before >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF)
    signs = np.flatnonzero(_SIGN[data[1:]] & _LETTER[data[:-1]]) + 1
    joint = np.sort(np.concatenate([at[sure], signs, texts]), kind="stable")
    return joint[np.concatenate([[True], joint[1:] != joint[:-1]])]


class Memo:
    """Ids of pieces: Arrow holds the bytes of the pieces, and one pool the ids of all, so an entry takes some 20
    bytes beside them. Never more than MEMO entries and MEMO_BYTES: where new ones do not fit, the half that
    batches ask for most often stays, and what was counted is halved."""

    def __init__(self):
        self.keys = pa.array([], pa.large_binary())
        self.first, self.size = np.empty(0, np.int32), np.empty(0, np.int32)
        self.pool = np.empty(0, "<u4")
        self.asked = np.empty(0, np.uint16)  # batches that held the piece

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.first.nbytes + self.size.nbytes + self.pool.nbytes + self.asked.nbytes

    def places(self, pieces: pa.Array) -> np.ndarray:
        """Where each piece stands, -1 for those not known."""
        if not len(self.keys):
            return np.full(len(pieces), -1, np.int32)
        at = pc.index_in(self.keys, value_set=pieces).fill_null(-1).to_numpy()  # the fewer are hashed
        held = np.flatnonzero(at >= 0)
        self.asked[held] += 1
        found = np.full(len(pieces), -1, np.int32)
        found[at[held]] = held
        return found

    def _keep(self, which: np.ndarray) -> None:
        at, size = self.first[which], self.size[which]
        self.keys = self.keys.take(pa.array(which))
        self.pool, self.first = _slices(self.pool, at, size)
        self.size, self.asked = size, self.asked[which] >> 1

    def add(self, pieces: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        """Pieces not known yet, and the ids of one after the other."""
        length = pc.binary_length(pieces).to_numpy()
        first = np.cumsum(size) - size
        which = np.flatnonzero(length <= LONGEST)
        cost = np.cumsum((length + 4 * size + 18)[which])
        if len(which) and (len(self.keys) + len(which) > MEMO or self.nbytes + int(cost[-1]) > MEMO_BYTES):
            oftener = np.argsort(~self.asked, kind="stable")[: len(self.keys) // 2]
            self._keep(np.sort(oftener))
            which = which[: MEMO - len(self.keys)]
            which = which[cost[: len(which)] <= MEMO_BYTES - self.nbytes - 64]
        if not len(which):
            return
        pool, begin = _slices(ids, first[which], size[which])
        self.keys = pa.concat_arrays([self.keys, pieces.take(pa.array(which))])
        self.first = np.concatenate([self.first, begin + np.int32(len(self.pool))]).astype(np.int32)
        self.size = np.concatenate([self.size, size[which]]).astype(np.int32)
        self.pool = np.concatenate([self.pool, pool])
        self.asked = np.concatenate([self.asked, np.ones(len(which), np.uint16)])


def _slices(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of ``data`` one after the other, and where each begins."""
    total = int(size.sum(dtype=np.int64))
    kind = np.int32 if max(total, len(data)) < 1 << 31 else np.int64
    begin = np.cumsum(size, dtype=kind) - size.astype(kind)
    return data[np.repeat(first.astype(kind) - begin, size) + np.arange(total, dtype=kind)], begin


class Pieces:
    """Ids of whole texts. ``encode`` gives the ids of some pieces, one after the other, and the number of each.

    ``apart`` are strings that are pieces of their own wherever they stand; of several at one place the longest.
    With ``folding`` a piece of ASCII and U+00C0 to U+00FF has the ids of its lower case, without the white space it begins with.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], white_space: bool = True, apart: Iterable[bytes] = (), folding: bool = False):
        self._encode, self._cut, self._folding = encode, white_space, folding
        self._apart = sorted(apart, key=len, reverse=True)
        self._any = re.compile(b"|".join(map(re.escape, self._apart)))
        self.memo = Memo()

    def _set_apart(self, begin: np.ndarray, texts: list[bytes], bounds: np.ndarray) -> np.ndarray:
        """Where pieces begin when every string of ``apart`` is one, and none is cut within."""
        spans = [(a + x.start(), a + x.end()) for text, a in zip(texts, bounds[:-1].tolist()) for x in self._any.finditer(text)]
        if not spans:  # the strings stood across the ends of texts only
            return begin
        first, last = np.array(spans, np.int64).T
        span = np.searchsorted(first, begin, "right") - 1
        outside = (span < 0) | (begin >= last[span])
        joint = np.unique(np.concatenate([begin[outside], first, last]))
        return joint[joint < bounds[-1]]

    def _folded(self, joint: bytes, data: np.ndarray, begin: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The pieces as they are looked up, one after the other, and where each begins and the last ends."""
        lower = np.frombuffer(bytearray(joint.translate(_LOWER)), np.uint8)
        other = np.zeros(len(begin), bool)
        if not joint.isascii():
            lead = data == 0xC3  # of U+00C0 to U+00FF
            after = np.flatnonzero(lead[:-1]) + 1
            upper = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
            lower[upper] += 0x20
            strange = (data >= 0x80) & ~lead
            strange[after] = False
            other |= np.logical_or.reduceat(strange, begin)
        if self._apart and any(x in joint for x in self._apart):
            other |= np.isin(begin, [m.start() for m in self._any.finditer(joint)])  # one of these strings: as it is
        if other.any():
            lower = np.where(np.repeat(other, np.diff(np.append(begin, len(data)))), data, lower)
        bare = ((data[begin] == SPACE) | (data[begin] == LINE)) & ~other
        keep = np.ones(len(data), bool)
        keep[begin[bare]] = False
        gone = np.cumsum(bare)
        return lower[keep].tobytes(), np.append(begin - (gone - bare), len(data) - gone[-1])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where those of each text begin and the last end."""
        joint = b"".join(texts)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        if not joint:
            return np.empty(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(joint, np.uint8)
        filled = bounds[:-1][np.diff(bounds) > 0]
        begin = starts(data, filled) if self._cut else filled
        if any(x in joint for x in self._apart):
            begin = self._set_apart(begin, texts, bounds)
        ends = np.append(begin, len(data))
        if self._folding:
            joint, ends = self._folded(joint, data, begin)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(joint)])
        folded = pieces.dictionary_encode()
        which, distinct = folded.indices.to_numpy(), folded.dictionary
        known = self.memo.places(distinct)
        new = distinct.filter(pa.array(known < 0))
        ids, counts = self._encode(new.to_pylist())
        sizes, first = np.empty(len(distinct), np.int32), np.empty(len(distinct), np.int64)
        sizes[known >= 0], first[known >= 0] = self.memo.size[known[known >= 0]], self.memo.first[known[known >= 0]]
        sizes[known < 0], first[known < 0] = counts, np.cumsum(counts) - counts + len(self.memo.pool)
        flat, after = _slices(np.concatenate([self.memo.pool, ids]), first[which], sizes[which])
        self.memo.add(new, ids, counts)
        return flat, np.append(after, len(flat))[np.searchsorted(begin, bounds)]


def tokenizer_pieces(path: str, added: bool = False) -> Pieces:
    """Pieces of a vocabulary file of the tokenizers library.

    With ``added`` the strings of added tokens give their ids, as the library does when it is loaded;
    without, those of special tokens are ordinary text. Added tokens that look at what stands around
    them, or at normalized text, leave texts uncut.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added
    tokens = tokenizer.get_added_tokens_decoder() if added else {}
    plain = not any(x.normalized or x.single_word or x.lstrip or x.rstrip for x in tokens.values())
    apart = [x.content for x in tokens.values()] if plain else []
    mark = next((k for k, x in tokens.items() if plain and not any(_overlap(x.content, y) for y in apart)), None)

    def each(pieces: list[bytes]) -> tuple[list[int], list[int]]:
        found = [x.ids for x in tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in pieces], add_special_tokens=False)]
        return [i for ids in found for i in ids], list(map(len, found))

    def joint(pieces: list[bytes]) -> tuple[list[int], list[int]]:
        """Many pieces in one text, with a mark behind each: what lies between marks is encoded by itself."""
        sign = tokens[mark].content.encode()
        ids = np.array(tokenizer.encode_batch_fast([(sign.join(pieces) + sign).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(ids == mark)
        if len(at) != len(pieces):  # a piece holds the mark, or gives its id
            return each(pieces)
        return ids[ids != mark], np.diff(at, prepend=-1) - 1

    made = json.loads(tokenizer.to_str())
    folding = plain and all(made[k] == v for k, v in FOLDING.items()) and made["model"]["type"] == "BPE" and not made["model"].get("dropout")
    # within words no added token may stand
    spaced = all(made[k] == v for k, v in BYTE_LEVEL.items()) and made["model"]["type"] == "BPE" and not made["model"].get("dropout")
    spaced = spaced and not any(_SPELLED(x["content"]) for x in made["added_tokens"])
    word_of = _WORD if folding else _SPACED if spaced else None
    model, as_bytes = tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    signs = {chr(i - 0x40): as_bytes.pre_tokenize_str(chr(i))[0][0][1] for i in range(0xC0, 0x100)}  # for the second byte of a letter
    signs[" "] = as_bytes.pre_tokenize_str(" ")[0][0]
    signs = {k: v for k, v in signs.items() if k != v}  # other bytes stand for themselves

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of a folding and of a byte-level vocabulary the model gets words of letters as they are, byte by byte."""
        words = np.array([word_of is not None and word_of(x) is not None for x in pieces], bool)
        if not words.any():
            return by_text(pieces)
        spelled = b"\n".join([p for p, w in zip(pieces, words.tolist()) if w]).decode("latin-1")
        for byte, sign in signs.items():
            spelled = spelled.replace(byte, sign)
        found, lengths = [], []  # flat, since a list per word keeps the garbage collector busy
        for word in spelled.split("\n"):
            own = [x.id for x in model.tokenize(word)]
            found += own
            lengths.append(len(own))
        rest, counts = by_text([p for p, w in zip(pieces, words.tolist()) if not w])
        sizes = np.empty(len(pieces), np.int64)
        sizes[words], sizes[~words] = lengths, counts
        ids = np.empty(int(sizes.sum()), "<u4")
        here = np.repeat(words, sizes)
        ids[here], ids[~here] = found, rest
        return ids, sizes

    def by_text(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        work = each if mark is None else joint
        parts = [work(pieces[at : at + TOGETHER]) for at in range(0, len(pieces), TOGETHER)]
        ids = [np.asarray(x, "<u4") for x, _ in parts]
        sizes = [np.asarray(x, np.int64) for _, x in parts]
        return np.concatenate([np.empty(0, "<u4"), *ids]), np.concatenate([np.empty(0, np.int64), *sizes])

    return Pieces(encode, plain, [x.encode() for x in apart], folding)


def _overlap(one: str, other: str) -> bool:
    """Whether an end of one string is a begin of the other, or the other way round, short of all of both."""
    return any(a[-k:] == b[:k] for a, b in ((one, other), (other, one)) for k in range(1, min(len(a), len(b)) + (a != b)))


def with_end(flat: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with one more id at the end of each."""
    return np.insert(flat, ends[1:], end_id).astype("<u4"), ends + np.arange(len(ends))
