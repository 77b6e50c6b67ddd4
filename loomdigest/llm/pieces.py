"""SentencePiece BPE encoding by backtracking, and decoding.

Merging pieces by score gives the one sequence of pieces in which every adjacent pair, when
merged anew from its letters, gives that same pair. It is found from the left: take the
longest piece at a position (Aho-Corasick finds all), check the pair with the piece before
by re-merging, fall back to the longest shorter piece, and go back a piece where none fits;
a bitfield notes positions from which no sequence can go on. Checked pairs are remembered.

Texts are cut first where no piece can reach across (before the mark of a space, and between
letters that no piece holds side by side); each cut is exact, and whole texts are covered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident, small_batches

MARK = "▁"
_UNITS = re.compile("▁+[^▁\n]*|[^▁\n]+|\n")


#: A text that other normalisers change: compositions, signs that have plain forms, blanks to trim.
_PROBE = "e\u0301 \ufb01 \u00bd \u212b A\u00a0b\u3000c  d \t e\r\n"


def _check(model) -> None:
    """Only models that leave texts as they are and mark blanks, also one put before, are handled."""
    for text in (_PROBE, " " + _PROBE, "a"):
        if model.normalize(text) != MARK + text.replace(" ", MARK):
            raise ValueError("a sentencepiece model that changes texts before it cuts them is not handled")


class PieceCoder:
    def __init__(self, model_file: str, remember: int = 400_000, pairs: int = 800_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        _check(model)
        self.piece = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = {i for i in range(len(self.piece)) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        self.id = {p: i for i, p in enumerate(self.piece) if i not in special}
        self.score = {p: (-model.get_score(i), i) for p, i in self.id.items()}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if model.is_byte(i)}
        self.byte_value = {i: b for b, i in self.byte.items()}
        self.unknown = model.unk_id()
        self.highest_special = max(special)
        self.hidden = {i for i in range(len(self.piece)) if model.is_control(i)}
        self.together = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.plain = all(MARK not in p.lstrip(MARK) and "\n" not in p for p in self.id)
        self.find = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.find.add_word(p, (i, len(p)))
        self.find.make_automaton()
        self.length = [len(p) for p in self.piece]
        self.decimal = [str(i) for i in range(len(self.piece))]
        self.shorter: dict[int, int] = {}  # the longest piece that begins a piece, once asked for
        self.fits: dict[int, bool] = {}
        self.units: dict[str, tuple[bytes, int, str]] = {}
        self.remember, self.pairs = remember, pairs

    # -- pieces ------------------------------------------------------------------------
    def merge(self, letters: list[str]) -> list[str]:
        """Merge adjacent symbols, best score first and leftmost among equals."""
        parts, score = list(letters), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s < best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            a, b = self.piece[left], self.piece[right]
            known = self.merge(list(a + b)) == [a, b]
            if len(self.fits) >= self.pairs:
                self.fits.clear()
            self.fits[key] = known
        return known

    def next_shorter(self, piece: int) -> int:
        """The longest piece that is a proper prefix; -1 if there is none."""
        known = self.shorter.get(piece)
        if known is None:
            text = self.piece[piece]
            known = next((self.id[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.id), -1)
            self.shorter[piece] = known
        return known

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text all of whose letters are pieces."""
        n = len(text)
        longest = [0] * n
        for end, (i, size) in self.find.iter(text):
            longest[end - size + 1] = i  # ends ascend, so the longest comes last
        failed = bytearray(n // 8 + 1)  # the bitfield: positions from which no sequence goes on
        out: list[int] = []
        length, fits, pos, token, last = self.length, self.fits, 0, longest[0], -1
        while True:
            while token >= 0:
                end = pos + length[token]
                if not failed[end >> 3] >> (end & 7) & 1:
                    # a piece that does not merge to itself fits nowhere; pairs show it, a lone first piece is asked
                    fit = fits.get(last << 20 | token) if last >= 0 else end < n or self.alone(token)
                    if self.compatible(last, token) if fit is None else fit:
                        break
                token = self.next_shorter(token)
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                pos, last, token = end, token, longest[end]
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                if not out:
                    raise ValueError(f"no sequence of pieces for {text[:40]!r}")
                token = out.pop()
                last = out[-1] if out else -1
                pos -= length[token]
                token = self.next_shorter(token)

    def alone(self, piece: int) -> bool:
        key = -1 - piece
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self.merge(list(self.piece[piece])) == [self.piece[piece]]
        return known

    # -- units and texts ---------------------------------------------------------------
    def unit_ids(self, unit: str) -> list[int]:
        together = self.together
        cuts = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in together]
        if not cuts:
            return self.part_ids(unit)
        out: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True):
            out += self.part_ids(unit[a:b])
        return out

    def part_ids(self, part: str) -> list[int]:
        if len(part) > 1:
            return self.backtrack(part)
        known = self.id.get(part)
        if known is not None:
            return [known]
        return [self.byte[b] for b in part.encode("utf-8", "replace")] if self.byte else [self.unknown]

    def split(self, text: str) -> list[str]:
        """Units that no piece reaches across, the mark put before the text and for each space."""
        if not text:
            return []
        if not self.plain:
            return [MARK + text.replace(" ", MARK)]
        if "  " not in text and text[0] != " " and MARK not in text and "\0" not in text:
            return (MARK + text.replace(" ", "\0" + MARK).replace("\n", "\0\n\0")).replace("\0\0", "\0").strip("\0").split("\0")
        return _UNITS.findall(MARK + text.replace(" ", MARK))

    def encode(self, text: str) -> list[int]:
        return [i for u in self.split(text) for i in self.unit_ids(u)]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of the ids; bytes join into characters, and one leading space is the mark put before."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            b = self.byte_value.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.hidden:
                out.append(self.piece[i])
        out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if first and text[:1] == " " else text

    def unit(self, unit: str) -> tuple[bytes, int, str]:
        """(decimal ids joined by commas, how many, decoded text) of a unit."""
        ids = self.unit_ids(unit)
        piece = self.piece
        plain = min(ids) > self.highest_special
        text = "".join([piece[i] for i in ids]).replace(MARK, " ") if plain else self.decode(ids, first=False)
        decimal = self.decimal
        return ",".join([decimal[i] for i in ids]).encode(), len(ids), text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(n_tokens, ids_sha256, decoded_sha256) of a whole text."""
        if not text:
            return 0, _EMPTY, _EMPTY
        known = self.units
        units = self.split(text)
        parts = list(map(known.get, units))
        if None in parts:
            room = self.remember
            for n, got in enumerate(parts):
                if got is None:
                    u = units[n]
                    got = parts[n] = self.unit(u)
                    if len(known) < room and len(u) <= 64:
                        known[u] = got
        decoded = "".join([p[2] for p in parts])
        if decoded[:1] == " ":
            decoded = decoded[1:]
        ids = b",".join([p[0] for p in parts])
        return sum([p[1] for p in parts]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()


_EMPTY = hashlib.sha256(b"").hexdigest()


def coder(model_file: str) -> PieceCoder:
    """One for each Python worker and model file."""
    return resident(("pieces", model_file), lambda: PieceCoder(model_file))


def encode(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded text of every row; null texts count as empty."""

    @F.arrow_udf("ids array<int>, decoded string")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = coder(model_file)
        for array in texts:
            ids = [c.encode(t or "") for t in array.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(i) for i in ids], pa.string())], ["ids", "decoded"])

    return docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("r")).select("doc_id", "r.ids", "r.decoded")


def digests(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    The digests of what ``encode`` gives, made as the texts go by. Null and empty texts have
    no ids. Repeated rows give repeated results, an empty table none; other columns are not
    read.
    """

    small_batches(docs.sparkSession)
    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = coder(model_file)
        for array in texts:
            got: list[tuple[int, str, str]] = []
            for at in range(0, len(array), 256):
                got += [c.digest(t) for t in array.slice(at, 256).to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("r")).select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")
