"""Token ids of whole texts by a public byte-level BPE, for packing and for the token files."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces, and pre-tokens of pieces, that a worker remembers, in two generations: the older half goes, but for what was seen again.
REMEMBERED, REMEMBERED_PARTS = 600_000, 500_000
#: Texts that are encoded together at most: the more, the fewer different pieces there are to each.
ROWS, BYTES = 2500, 10 << 20
_open: dict[str, "Encoder"] = {}
_common_letters = re.compile(r"[\x00-ɏ‐-‧]*\Z")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory:
    """A dict in two generations."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def turn(self) -> None:
        if len(self.new) > self.most // 2:
            self.new, self.old = {}, self.new

    def get(self, keys: list[str], learn) -> list:
        """The values of `keys`, which are all different; learn(missing) gives those of new ones."""
        new = self.new
        found = list(map(new.get, keys))
        gaps = [k for k, x in enumerate(found) if x is None]
        if gaps:
            missing = [keys[k] for k in gaps]
            values = list(map(self.old.get, missing))
            fresh = [key for key, x in zip(missing, values) if x is None]
            if fresh:
                learnt = iter(learn(fresh))
                values = [next(learnt) if x is None else x for x in values]
            new.update(zip(missing, values))
            for k, x in zip(gaps, values):
                found[k] = x
        return found


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    A pre-token of this tokenizer takes a space at its front only, so a text falls at every single space between two
    other characters into pieces with ids of their own. A batch's pieces are told apart by Arrow; each worker asks the
    tokenizer once for each piece, or for the pre-tokens in it, and remembers the answers. A text with white space of
    any other shape around its spaces, or with the content of an added token, such as the end mark, is encoded as a whole. tests/llm hold all of it against the ids of whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        #: Contents of added tokens, which the tokenizer cuts out of a text before anything else.
        self.added = sorted(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        #: The same model, given words of byte letters that stand line by line.
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.pre_tokenizer = CharDelimiterSplit("\n")
        self.letters = self.byte_letters()
        self.inside = {b: letter for b, letter in self.letters.items() if b != 10}
        self.long = np.array([len(self.model.id_to_token(i) or "") for i in range(self.model.get_vocab_size(with_added_tokens=True))])
        self.pieces, self.parts, self.heads = Memory(REMEMBERED), Memory(REMEMBERED_PARTS), Memory(50_000)
        self.split = None

    @staticmethod
    def byte_letters() -> dict[int, str]:
        """The letter that stands for each byte, found out from the pre-tokenizer itself."""
        from tokenizers.pre_tokenizers import ByteLevel

        plain = ByteLevel(add_prefix_space=False, use_regex=False)
        out = {}
        for b in range(128):
            out[b] = plain.pre_tokenize_str(chr(b))[0][0]
        for b in range(0x80, 0x100):  # as the first or a later byte of a character's UTF-8
            for point in (b - 0x80 + 0x80, (b & 0x1F) << 6, (b & 0x0F) << 12 | 0x0800, (b & 0x07) << 18 | 0x10000):
                try:
                    raw = chr(point).encode()
                except (UnicodeEncodeError, ValueError, OverflowError):
                    continue
                for x, letter in zip(raw, plain.pre_tokenize_str(chr(point))[0][0]):
                    out[x] = letter
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def wholes(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> list:
        """The ids of a space and the piece; False for a piece that touches other white space."""
        out: dict[str, bytes | bool] = {}
        words = [p for p in pieces if p.isalpha()]  # a pre-token each
        if not _common_letters.match("".join(words)):
            words = [p for p in words if _common_letters.match(p)]
        out.update(zip(words, self.learn_words(words)))
        clean, rare = [], []
        for p in pieces:
            if p in out:
                continue
            if not p or p[0].isspace() or p[-1].isspace():
                out[p] = False
            else:
                (clean if _common_letters.match(p) else rare).append(p)
        out.update((p, self.whole(" " + p)) for p in rare)
        if self.split is None:
            import public_tokenizers
            import regex

            self.split = regex.compile(public_tokenizers.PATTERN).findall
        for at in range(0, len(clean), 5000):
            group = clean[at : at + 5000]
            parts = self.split("".join([" " + p for p in group]))
            different = list(dict.fromkeys(parts))
            ids = dict(zip(different, self.parts.get(different, self.learn_parts)))
            data = list(map(ids.__getitem__, parts))
            starts = [k for k, p in enumerate(parts) if p[0] == " "]  # a clean piece has no other space
            out.update(zip(group, (b"".join(data[a:b]) for a, b in zip(starts, [*starts[1:], len(parts)]))))
        return [out[p] for p in pieces]

    def learn_parts(self, parts: list[str]) -> list[bytes]:
        spelt = [p.encode().decode("latin-1").translate(self.letters) for p in parts]
        out: list[bytes] = []
        for at in range(0, len(spelt), 5000):
            out += self.modelled("\n".join(spelt[at : at + 5000]))
        return out

    def learn_words(self, words: list[str]) -> list[bytes]:
        """The ids of a space and the word, for words of letters only: they are spelt together, as no letter is a line's end."""
        out: list[bytes] = []
        for at in range(0, len(words), 5000):
            lines = " " + "\n ".join(words[at : at + 5000])
            out += self.modelled(lines.encode().decode("latin-1").translate(self.inside))
        return out

    def modelled(self, lines: str) -> list[bytes]:
        """The ids of each line of byte letters."""
        ids = np.array(self.model.encode_batch_fast([lines], add_special_tokens=False)[0].ids, "<u4")
        data, ends = ids.tobytes(), np.cumsum(self.long[ids])  # tokens spell their words letter by letter
        bounds = (np.searchsorted(ends, np.cumsum([0, *map(len, lines.split("\n"))]), "right") * 4).tolist()
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts) -> list[bytes]:
        """`texts`: a list, or an Arrow array of strings without nulls."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out: list[bytes] = []
        for at in range(0, len(column), ROWS):
            coded = column.slice(at, ROWS).dictionary_encode()  # copies in a batch are encoded once
            ids = self._encode(coded.dictionary)
            out.extend(map(ids.__getitem__, coded.indices.to_pylist()))
        return out

    def _encode(self, column: pa.Array) -> list[bytes]:
        if not len(column):
            return []
        self.pieces.turn()
        self.parts.turn()
        self.heads.turn()
        lists = pc.split_pattern(column, " ")
        edges = lists.offsets.to_numpy().astype(np.int64)
        words = lists.flatten()
        edges = edges - edges[0]
        coded = words.dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        different = coded.dictionary.to_pylist()
        found = self.pieces.get(different, self.learn)
        bad = np.array([x is False for x in found])
        heads = words.take(pa.array(edges[:-1])).to_pylist()  # the first piece of a text has no space before it
        index[edges[:-1]] = len(found) + np.arange(len(heads))
        odd = np.array([not h or h[-1].isspace() for h in heads])
        for mark in self.added:
            odd |= pc.match_substring(column, mark).to_numpy(zero_copy_only=False)
        if bad.any():
            marks = np.concatenate((bad, odd))[index]
            odd = np.logical_or.reduceat(marks, edges[:-1])
        data = [b"" if x is False else x for x in found]
        alone = list(dict.fromkeys(h for h, o in zip(heads, odd.tolist()) if not o))
        opening = dict(zip(alone, self.heads.get(alone, self.wholes)))
        data += [b"" if o else opening[h] for h, o in zip(heads, odd.tolist())]
        lengths = np.fromiter(map(len, data), np.int64, len(data)) >> 2
        flat = np.frombuffer(b"".join(data), "<u4")
        begins = np.cumsum(lengths) - lengths
        each = lengths[index]
        upto = np.cumsum(each)
        shift = (begins[index] - (upto - each)).astype(np.int32)  # a batch has far fewer than 2^31 ids
        ids = flat[np.repeat(shift, each) + np.arange(int(upto[-1]), dtype=np.int32)]
        cut = np.concatenate(([0], upto))[edges].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(cut, cut[1:])]
        for k in np.flatnonzero(odd).tolist():
            text = column[k].as_py()
            out[k] = self.whole(text) if text else b""
        return out


def gathered(batches, column: str = "text", most: int = ROWS):
    """Arrow batches put together up to `most` rows or BYTES of `column`."""
    some: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if some and (rows + batch.num_rows > most or size + batch.column(column).nbytes > BYTES):
            yield pa.Table.from_batches(some).combine_chunks()
            some, rows, size = [], 0, 0
        some.append(batch)
        rows, size = rows + batch.num_rows, size + batch.column(column).nbytes
    if some:
        yield pa.Table.from_batches(some).combine_chunks()


def flat(table: pa.Table, column: str) -> pa.Array:
    """A column of a table of one chunk, as plain 32-bit strings where it is strings."""
    chunks = table.column(column).chunks
    got = chunks[0] if chunks else pa.array([], table.schema.field(column).type)
    return got.cast(pa.string()) if pa.types.is_large_string(got.type) else got


def encoder(path: str, share: float = 1.0) -> Encoder:
    """The worker's encoder; `share` of what a worker may remember, where memory is needed beside it."""
    if path not in _open:
        _open[path] = Encoder(path)
    made = _open[path]
    made.pieces.most, made.parts.most = int(share * REMEMBERED), int(share * REMEMBERED_PARTS)
    return made
