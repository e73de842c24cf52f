"""BPE encoding by backtracking over longest token matches; decoding by offsets.

An Aho-Corasick automaton finds, in one pass over a piece, all tokens that
start at each place. The encoder takes the longest that the pair-compatibility
table allows after the token before it: two tokens are compatible if merging
their joint bytes gives just these two. Where none fits, it steps back, and the
place is closed for good, because the encoding of a prefix is unique; so each
place is left at most once and the time is linear in the piece. A sequence of
pairwise compatible tokens is the result of the merges.

Compatibility needs no merging. On either side of the seam stand, one after the
other while the merges run, the tokens down the right edge of the left token's
merge tree and down the left edge of the right one's. The pair is incompatible
if two of them have a merge that comes due before either is used up.
"""

import json
import re
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.texts import fresh_name
from tessella.llm.tokenizers import Memo, Vocabulary, byte_letters

#: The published pattern that splits text before the byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than single blanks and line ends makes the plain cut unsafe.
UNUSUAL = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
NEVER = 1 << 60
COMPATIBLE_LIMIT = 400_000
#: Texts that a worker holds as strings at a time.
AT_A_TIME = 64


class OffsetDecoder:
    """All token bytes in one buffer; an offset table cuts them out."""

    def __init__(self, tokens: list[bytes]):
        self.buffer = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        shift = self.starts[ids] - (ends - sizes)
        return self.buffer[np.repeat(shift, sizes) + np.arange(ends[-1])].tobytes()

    def text(self, ids: np.ndarray) -> str:
        return self.decode(ids).decode("utf-8", "replace")


class TokenTable:
    """The bytes of every token of a byte-level BPE in the tokenizers library's JSON."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        letters, model = byte_letters(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"] if t not in self.special}
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = [(raw[a], raw[b]) for a, b in merges]
        self.ids = {raw[t]: model["vocab"][t] for t in raw}
        self.bytes_of = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, i in [*self.ids.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.bytes_of[i] = token


def build_decoder(vocabulary: str) -> OffsetDecoder:
    return OffsetDecoder(TokenTable(vocabulary).bytes_of)


class BacktrackingEncoder:
    def __init__(self, vocabulary: str):
        table = TokenTable(vocabulary)
        self.special, self.bytes_of = table.special, table.bytes_of
        self.ids = ids = table.ids
        self.rank = {pair: r for r, pair in enumerate(table.merges)}
        self.size = [len(t) for t in self.bytes_of]
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.kind = np.dtype("<u2" if len(self.bytes_of) <= 1 << 16 else "<u4")
        self.due = {(ids[a] << 32) + ids[b]: r for (a, b), r in self.rank.items()}
        self.made_by = {ids[a + b]: (r, ids[a], ids[b]) for (a, b), r in self.rank.items()}
        self.right_edge = Memo(lambda t: self._edge(t, 1), 1 << 20)
        self.left_edge = Memo(lambda t: self._edge(t, 0), 1 << 20)
        self.arises = [-1] * len(self.bytes_of)
        self.compatible: dict[int, bool] = {}
        self.pieces = Memo(self._piece, 50_000, longest=48)
        self.after_blank = Memo(self._after_blank, 320_000, longest=24)

    def merged(self, piece: bytes) -> list[int]:
        """Apply the merges by rank; only tells which tokens arise at all."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.rank.get(p, NEVER), i) for i, p in enumerate(pairwise(parts)))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens down one edge of the merge tree, each with the rank that uses it up."""
        edge, used_at = [], NEVER
        while token >= 0:
            edge.append((token, used_at))
            used_at, *halves = self.made_by.get(token, (NEVER, -1, -1))
            token = halves[side]
        return edge

    def fits(self, left: int, right: int) -> bool:
        """The pair-compatibility table, filled as pairs come up; left -1: a token by itself."""
        key = (left << 32) + right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= COMPATIBLE_LIMIT:
                self.compatible.clear()
            known = self._arises(right) and (left < 0 or self._seam_holds(left, right))
            self.compatible[key] = known
        return known

    def _arises(self, token: int) -> bool:
        if self.arises[token] < 0:
            self.arises[token] = self.merged(self.bytes_of[token]) == [token]
        return bool(self.arises[token])

    def _seam_holds(self, left: int, right: int) -> bool:
        rights = self.left_edge[right]
        for a, a_until in self.right_edge[left]:
            for b, b_until in rights:
                due = self.due.get((a << 32) + b, NEVER)
                if due < a_until and due <= b_until and due < NEVER:
                    return False
        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None and self.fits(-1, whole):
            return [whole]
        letters = piece.decode("latin-1")
        longest = [token for _, token in self.automaton.iter_long(letters)]
        if all(map(self.fits, [-1, *longest[:-1]], longest)):
            return longest
        n, size, compatible = len(piece), self.size, self.compatible
        starting: list[list[int]] = [[] for _ in range(n)]  # by length, as ends come in order
        for last, token in self.automaton.iter(letters):
            starting[last + 1 - size[token]].append(token)
        closed = bytearray(n + 1)
        path: list[tuple[int, int, list[int]]] = []  # (token, its start, shorter ones there)
        at, before, options = 0, -1, starting[0]
        while at < n:
            while options:
                token = options.pop()
                end = at + size[token]
                if not closed[end]:
                    known = compatible.get((before << 32) + token)
                    if known or (known is None and self.fits(before, token)):
                        break
            else:
                closed[at] = 1
                _, at, options = path.pop()
                before = path[-1][0] if path else -1
                continue
            path.append((token, at, options))
            at, before = end, token
            if at < n:
                options = starting[at]
        return [token for token, _, _ in path]

    def _piece(self, piece: str) -> bytes:
        return np.array(self.encode_piece(piece.encode()), self.kind).tobytes()

    def _pretokenized(self, text: str) -> bytes:
        return b"".join([self.pieces[p] for p in self.split(text)])

    def _after_blank(self, chunk: str) -> bytes:
        if chunk[-1:] in (",", ".") and chunk[:-1].isalpha():
            return self.after_blank[chunk[:-1]] + self.pieces[chunk[-1]]
        parts = self.split(" " + chunk)
        return self._piece(parts[0]) if len(parts) == 1 else b"".join([self.pieces[p] for p in parts])

    def _plain(self, text: str) -> bytes:
        """Text without special tokens. Where every blank stands alone between
        other characters, each chunk after a blank splits independently."""
        if "  " in text or " \n" in text or "\n " in text or text[-1:] == " " or text[:1] == " " or UNUSUAL.search(text):
            return self._pretokenized(text)
        first, *rest = text.split(" ")
        return self._pretokenized(first) + b"".join([self.after_blank[c] for c in rest])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; special tokens in it are found first, as they stand."""
        if self.specials is None or not any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), self.kind)
        ids = b""
        for part in self.specials.split(text):
            special = self.special.get(part)
            ids += self._plain(part) if special is None else np.array([special], self.kind).tobytes()
        return np.frombuffer(ids, self.kind)


def _encoded(encoder: BacktrackingEncoder, column: pa.Array) -> list[np.ndarray]:
    """The ids of each text; beside the column and the ids, few texts are held."""
    return [encoder.encode(v or "") for at in range(0, len(column), AT_A_TIME) for v in column.slice(at, AT_A_TIME).to_pylist()]


def _id_lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.empty(ends[-1], np.int32)
    for row, at, end in zip(rows, ends, ends[1:]):
        flat[at:end] = row
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encode_texts(docs: DataFrame, vocabulary: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text (array<int>); null: empty.

    ``vocabulary``: path of a byte-level BPE in the tokenizers library's JSON.
    """
    shared = Vocabulary(docs.sparkSession, vocabulary)

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        return _id_lists(_encoded(shared.build(BacktrackingEncoder), column))

    return docs.withColumn(out_col, run.asNondeterministic()(F.col(text_col)))


def decode_ids(tokens: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``tokens`` with the text of each id list; bytes that aren't UTF-8 become U+FFFD.

    A null list gives the empty text; an id outside the vocabulary stops the job.
    """
    shared = Vocabulary(tokens.sparkSession, vocabulary)

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        decoder = shared.build(build_decoder)
        lists = pa.chunked_array([column]) if isinstance(column, pa.Array) else column
        out = []
        for chunk in lists.chunks:
            flat, ends = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
            valid = chunk.is_valid().to_pylist()
            out += [decoder.text(flat[a:b]) if ok else "" for (a, b), ok in zip(pairwise(ends.tolist()), valid)]
        return pa.array(out, pa.string())

    return tokens.withColumn(out_col, run.asNondeterministic()(F.col(ids_col)))


def round_trip(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the columns of ``encode_texts`` and of ``decode_ids`` over its ids.

    Both are done by one worker a task, where two operators one after the other
    take two with a vocabulary each.
    """
    shared = Vocabulary(docs.sparkSession, vocabulary)
    both = fresh_name(docs, "both")

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def run(column: pa.Array) -> pa.Array:
        encoder, decoder = shared.build(BacktrackingEncoder), shared.build(build_decoder)
        rows = _encoded(encoder, column)
        texts = pa.array((decoder.text(row) for row in rows), pa.string(), size=len(rows))
        return pa.StructArray.from_arrays([_id_lists(rows), texts], names=["ids", "decoded"])

    found = docs.withColumn(both, run.asNondeterministic()(F.col(text_col)))
    return found.withColumns({ids_col: F.col(both)["ids"], out_col: F.col(both)["decoded"]}).drop(both)
