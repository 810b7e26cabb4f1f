"""Splitting oversized texts at natural boundaries, with overlap between pieces.

The tokenizer turns a text into a string of classes, one character a token, that
tells how strong a boundary the text has behind that token:

    H heading next   P paragraph   L line   S sentence   W word
    t change between letters, digits and marks   x other character boundary
    y no cut possible

A regular expression with bounded quantifiers then extracts the pieces: its
alternatives, ordered by boundary strength, each consume up to the limit, down
to half of it for natural boundaries, and fall back to a bare character
boundary. Classes and the ends of the matches come from one pass over Arrow
batches; overlaps, places and texts follow by SQL array functions on them. Texts
and classes travel as bytes, of which a slice is taken without reading what lies
before it, so the work grows with the length of a text and not with its square.

A cut between two tokens of a text leaves the tokens on both sides as they are,
so the size of a piece is the number of its tokens; encoding the piece by
itself gives at most that many (blanks at its end may merge).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import MODEL, TOKENIZERS, Encoder, _slices, encoder

#: Tokens that the start of an overlap may move back to a place where a cut is possible.
SLACK = 5

# Characters that end a sentence, those that do so without a blank behind, and what may close it.
_STOPS, _FULL, _CLOSERS = ".!?…", "。！？", "\"'”’»)]"
_UNDERLINED = re.compile(r"[\r\n][ \t]*(?=[^\r\n]{1,120}\r?\n[ \t]*(?:={3,}|-{3,})[ \t]*(?:\r|\n|$))")
_LETTER, _DIGIT, _SPACE, _OTHER = range(4)


_UNKNOWN = 255
#: Kind of each code point, filled in as they turn up.
_KINDS = np.full(0x110000, _UNKNOWN, dtype=np.uint8)


def _kinds(cp: np.ndarray) -> np.ndarray:
    """Kind of each character: letter, digit, white space or other."""
    out = _KINDS[cp]
    if (out == _UNKNOWN).any():
        for x in np.unique(cp[out == _UNKNOWN]).tolist():
            c = chr(x)
            _KINDS[x] = _SPACE if c.isspace() else _LETTER if c.isalpha() else _DIGIT if c.isnumeric() else _OTHER
        out = _KINDS[cp]
    return out


def _any(cp: np.ndarray, chars: str) -> np.ndarray:
    out = cp == ord(chars[0])
    for c in chars[1:]:
        out |= cp == ord(c)
    return out


def classes(enc: Encoder, text: str, ids: bytes) -> tuple[str, np.ndarray, np.ndarray]:
    """Boundary class behind each token of a text, and the characters and bytes up to there.

    Everything is looked up at once for all tokens: at a token's end lies the
    character before it, the one behind it, and the blanks and line ends between
    it and the last character that is neither.
    """
    end, whole, byte_end = enc.ends(text, ids)
    n = len(text)
    cp = np.frombuffer(text.encode("utf-32-le", errors="surrogatepass"), dtype=np.uint32)
    kind = _kinds(cp)
    before, behind = kind[end - 1], np.append(kind, np.uint8(_SPACE))[end]
    where = np.arange(n, dtype=np.int32)
    newline = cp == 10
    if "\r" in text:
        newline |= (cp == 13) & (np.append(cp[1:], 0) != 10)
    lines = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(newline, out=lines[1:])
    # Last characters up to each place that are no blanks, and no white space at all.
    blank = (cp == 32) | (cp == 9)
    last = np.maximum.accumulate(np.where(blank, -1, where))[end - 1]
    ink = np.maximum.accumulate(np.where(kind == _SPACE, -1, where))[end - 1]
    at_line = (last >= 0) & _any(cp[np.maximum(last, 0)], "\n\r") & (end < n)
    broken = lines[end] - lines[ink + 1]
    code = np.append(cp, np.zeros(2, np.uint32))
    heading = np.zeros(len(end), dtype=bool)
    if "#" in text:
        # The next character that is no blank.
        nxt = np.minimum.accumulate(np.where(blank, n, where)[::-1])[::-1]
        ahead = np.append(nxt, np.int32(n))[end]
        heading |= at_line & (code[ahead] == ord("#")) & _any(code[ahead + 1], "# ")
    if "===" in text or "---" in text:
        under = np.zeros(n + 1, dtype=bool)
        under[[m.end() for m in _UNDERLINED.finditer(text)]] = True
        heading |= at_line & under[end]
    p1, p2 = cp[end - 1], code[np.maximum(end - 2, 0)]
    stop = (_any(p1, _STOPS) | (_any(p1, _CLOSERS) & _any(p2, _STOPS))) & (behind == _SPACE)
    marks = np.full(len(end), ord("x"), dtype=np.uint8)
    marks[before != behind] = ord("t")
    marks[(before == _SPACE) | (behind == _SPACE)] = ord("W")
    marks[stop | _any(p1, _FULL)] = ord("S")
    marks[at_line] = ord("L")
    marks[at_line & (broken >= 2)] = ord("P")
    marks[heading] = ord("H")
    # No cut within a character, nor in front of an apostrophe among other marks:
    # it would be read as the beginning of a contraction there.
    marks[~whole | ((before == _OTHER) & (code[end] == ord("'")))] = ord("y")
    return marks.tobytes().decode(), end.astype(np.int32), byte_end.astype(np.int32)


def piece_pattern(limit: int, first: int) -> str:
    """The bounded-quantifier expression over a string of classes.

    `first` is the limit of the first piece, `limit` that of later ones, which
    also carry an overlap. It matches at every place, so its matches follow each
    other without gaps.
    """

    def ladder(n: int) -> str:
        low = n // 2 - 1
        strong = [f".{{{low},{n - 1}}}[{c}]" for c in ("H", "HP", "HPL", "HPLS", "HPLSW")]
        return "|".join([rf".{{1,{n}}}\Z", *strong, f".{{0,{n - 1}}}[HPLSWt]", f".{{0,{n - 1}}}[^y]", f".{{1,{n}}}"])

    return rf"\A(?:{ladder(first)})|(?!\A)(?:{ladder(limit)})"


def split_texts(
    df: DataFrame,
    key: str,
    text: str,
    max_tokens: int,
    overlap: int,
    root: str = TOKENIZERS,
    model: str = MODEL,
) -> DataFrame:
    """The ordered pieces of each text.

    Columns: key, piece_no (from 1), start_char, n_tokens, overlap_tokens (shared
    with the piece before), boundary (class of its end, `E` for the text's end),
    piece. A text within `max_tokens` is one piece; so is an empty or null text,
    with 0 tokens. Pieces have at most max_tokens tokens, each later one begins
    `overlap` tokens before the end of the piece before (a few more where a cut
    isn't possible there). One text is handled by one task; texts aren't
    shuffled. Repeated rows give repeated pieces.
    """
    if not 0 <= overlap or max_tokens < 2 * (overlap + SLACK):
        raise ValueError("max_tokens must be at least twice the overlap plus ten")

    step = max_tokens - overlap - SLACK
    pattern = piece_pattern(step, max_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, find = encoder(root, model), re.compile(pattern).finditer
        for batch in batches:
            for part in _slices(batch):
                texts = part.column(1).to_pylist()
                coded = enc.encode(texts)
                counts = [len(b) // 4 for b in coded]
                over = [n > max_tokens for n in counts]
                laid = [classes(enc, t, b) if o else (None, None, None) for t, b, o in zip(texts, coded, over)]
                cuts = [[0, *(m.end() for m in find(c))] if o else None for (c, _, _), o in zip(laid, over)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([None if o else t for t, o in zip(texts, over)], pa.string()),
                        pa.array([t.encode("utf-8", errors="surrogatepass") if o else None for t, o in zip(texts, over)], pa.binary()),
                        pa.array(counts, pa.int32()),
                        pa.array([c.encode() if o else None for (c, _, _), o in zip(laid, over)], pa.binary()),
                        pa.array([e for _, e, _ in laid], pa.list_(pa.int32())),
                        pa.array([b for _, _, b in laid], pa.list_(pa.int32())),
                        pa.array(cuts, pa.list_(pa.int32())),
                    ],
                    names=["key", "text", "raw", "n", "cls", "ends", "bytes", "cuts"],
                )

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    laid = rows.mapInArrow(run, f"key {dict(df.dtypes)[key]}, text string, raw binary, n int, cls binary, ends array<int>, bytes array<int>, cuts array<int>")

    def upto(values: str, tokens: Column) -> Column:
        """What the first so many tokens come to."""
        return F.when(tokens > 0, F.get(F.col(values), tokens - 1)).otherwise(0)

    # Each piece with its number, the end of the one before and its own, in tokens.
    each = F.transform(
        F.sequence(F.lit(0), F.size("cuts") - 2),
        lambda i: F.struct(i.alias("no"), F.get("cuts", i).alias("prior"), F.get("cuts", i + 1).alias("end")),
    )

    def begins(p: Column) -> Column:
        # Where the piece before ended, less the overlap; back to a place where the text can be cut.
        wish = F.greatest(p["prior"] - overlap, F.lit(0))
        low = F.greatest(wish - SLACK, F.lit(0))
        back = F.regexp_extract(F.substring(F.col("cls"), low + 1, wish - low).cast("string"), "^(.*[^y])", 1)
        return F.when(p["no"] == 0, 0).otherwise(low + F.length(back)).cast("int")

    placed = F.transform(each, lambda p: F.struct(p["no"].alias("no"), p["prior"].alias("prior"), p["end"].alias("end"), begins(p).alias("begin")))

    def piece(p: Column) -> Column:
        at = upto("bytes", p["begin"])
        return F.struct(
            (p["no"] + 1).alias("piece_no"),
            upto("ends", p["begin"]).alias("start_char"),
            (p["end"] - p["begin"]).alias("n_tokens"),
            (p["prior"] - p["begin"]).alias("overlap_tokens"),
            F.when(p["end"] == F.col("n"), "E").otherwise(F.substring(F.col("cls"), p["end"], F.lit(1)).cast("string")).alias("boundary"),
            F.substring(F.col("raw"), at + 1, upto("bytes", p["end"]) - at).cast("string").alias("piece"),
        )

    zero = F.lit(0)
    alone = F.array(F.struct(F.lit(1).alias("piece_no"), zero.alias("start_char"), F.col("n").alias("n_tokens"), zero.alias("overlap_tokens"), F.lit("E").alias("boundary"), F.col("text").alias("piece")))
    pieces = laid.select("key", F.explode(F.when(F.col("cuts").isNotNull(), F.transform(placed, piece)).otherwise(alone)).alias("p"))
    return pieces.select(F.col("key").alias(key), "p.*")
