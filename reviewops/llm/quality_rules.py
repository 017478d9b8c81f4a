"""Quality rules from compression bands.

Text that says the same again and again compresses far better than prose, random text far
worse. How well prose compresses depends on its length, so every length band has limits of
its own. They are applied to the whole document and, as a long document may hide a bad
stretch, to chunks of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from reviewops.llm import scan


@dataclass(frozen=True)
class Band:
    """Texts of at least ``from_bytes``: bytes divided by compressed bytes must lie in low to high; ``wide`` is low for wide texts."""

    from_bytes: int
    low: float
    high: float
    wide: float = 0.0


#: The upper limits leave prose a factor of two. The lower ones lie between noise and the lowest of 67 languages
#: (Czech, Slovak): lines of base64 reach 1.08 at 256 bytes, 1.21 at 640, 1.27 at 1 KB and 1.33 at most, words of random
#: letters and digits 1.27, 1.34 and 1.40 from 640 bytes on; prose has 1.1, 1.3, 1.4, at 4 KB 1.76 and at 8 KB 1.93.
#: Below 640 bytes such words can't be told from prose, only base64 can. Wide texts, those with a third of their bytes
#: or more outside ASCII, aren't base64, and each of their characters says more: Chinese has 1.01 at 256 bytes, 1.24 at
#: 1 KB and 1.6 at 4 KB, ideographs drawn at random 1.08, 1.31 and 1.38, so these are told apart from 1.5 KB on.
BANDS = (Band(0, 0.0, 4.0), Band(256, 1.1, 4.0, 0.9), Band(288, 1.12, 4.0, 0.9), Band(320, 1.14, 4.0, 0.9), Band(352, 1.16, 4.0, 0.9),
         Band(384, 1.18, 4.0, 0.9), Band(448, 1.2, 4.0, 0.9), Band(512, 1.22, 4.0, 1.1), Band(640, 1.3, 4.0, 1.1), Band(768, 1.32, 4.0, 1.1),
         Band(896, 1.33, 4.0, 1.1), Band(1024, 1.36, 4.5, 1.2), Band(1280, 1.4, 4.5, 1.2), Band(1536, 1.43, 4.5, 1.35), Band(2048, 1.47, 5.0, 1.39),
         Band(4096, 1.6, 5.0, 1.48), Band(8192, 1.65, 6.0, 1.55), Band(65536, 1.65, 7.0, 1.55))

_TYPE = pa.struct([(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                  + [("ratio", pa.float64()), ("bad_share", pa.float64()), ("in_band", pa.bool_())])
_DDL = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "ratio double, bad_share double, in_band boolean")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[ends])


def _repeated_words(words: scan.Words, run: int) -> np.ndarray:
    """Words of each text in a run of ``run`` words that the text holds twice or more."""
    at, keys = words.runs(words.hashes(), run)
    keys = keys ^ scan.mix(words.text[at].astype(np.uint64) + np.uint64(1))
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    cover = np.zeros(len(words.starts) + 1, dtype=np.int64)
    if len(twice):
        hit = at[np.isin(keys, twice)]
        cover[hit] += 1
        np.subtract.at(cover, hit + run, 1)
    return _per_text(np.cumsum(cover[:-1]) > 0, words.first)


def _duplicate_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def _compression(text: bytes, packer: zstandard.ZstdCompressor, bands: tuple[Band, ...], chunk: int) -> tuple[float, float, bool]:
    """Ratio of the whole, share of bytes in chunks outside their band, and whether the whole is inside."""
    if not text:
        return 0.0, 0.0, True

    def judged(part: bytes) -> tuple[float, bool]:
        ratio = len(part) / len(packer.compress(part))
        band = next(b for b in reversed(bands) if len(part) >= b.from_bytes)
        wide = 3 * np.count_nonzero(np.frombuffer(part, np.uint8) & 0x80) >= len(part)
        return ratio, (band.wide if wide else band.low) <= ratio <= band.high

    ratio, good = judged(text)
    bad = 0
    if len(text) > chunk:
        for i in range(0, len(text), chunk):
            part = text[i:i + chunk]
            bad += 0 if judged(part)[1] else len(part)
    return ratio, bad / len(text), good


def _measures(column: pa.Array, bands: tuple[Band, ...], chunk: int, level: int, run: int) -> pa.Array:
    packer = zstandard.ZstdCompressor(level=level)
    parts = []
    for batch in scan.pieces(pa.record_batch({"t": column}), "t"):
        data, ends = scan.texts(batch.column(0))
        words = scan.Words(data, ends)
        whole = data.tobytes()
        each = [whole[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        ratios = [_compression(t, packer, bands, chunk) for t in each]
        inside = ~scan.SPACE[data] & ((data & 0xC0) != 0x80)
        parts.append(pa.StructArray.from_arrays(
            [pa.array(words.counts.astype(np.int64)), pa.array(_per_text(inside, ends)), pa.array(_per_text(_SYMBOL[data], ends)),
             pa.array([_duplicate_lines(t) for t in each], pa.int64()), pa.array(_repeated_words(words, run)),
             pa.array([r[0] for r in ratios], pa.float64()), pa.array([r[1] for r in ratios], pa.float64()),
             pa.array([r[2] for r in ratios], pa.bool_())], fields=list(_TYPE)))
    return pa.concat_arrays(parts) if parts else pa.array([], _TYPE)


def measured(docs: DataFrame, text: str = "text", into: str = "rules", bands: tuple[Band, ...] = BANDS, chunk: int = 4096,
             level: int = 3, run: int = 8) -> DataFrame:
    """The documents with one more column ``into``, a struct of the measures of each text.

    Null counts as empty; an empty text has ratio 0 and is inside its band. Nothing is
    shuffled; a row's measures depend on its text alone, so repeated rows get equal ones.
    A column already called ``into`` is replaced.
    """
    @F.arrow_udf(_DDL)
    def measure(column: pa.Array) -> pa.Array:
        return _measures(column, bands, chunk, level, run)

    return docs.withColumn(into, measure.asNondeterministic()(F.col(text)))


def verdict(rules: str = "rules", min_words: int = 20, max_repeat: int = 30, max_bad: float = 0.25):
    """Two columns: whether the base rules reject a document, and whether it stays.

    It stays if they don't, its whole text compresses within the band of its length and at
    most ``max_bad`` of its bytes are in chunks outside theirs.
    """
    failed = (F.col(f"{rules}.n_words") < min_words) | (100 * F.col(f"{rules}.n_repeat_words") > max_repeat * F.col(f"{rules}.n_words"))
    return failed, ~failed & F.col(f"{rules}.in_band") & (F.col(f"{rules}.bad_share") <= max_bad)


def filtered(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that stay, with their own columns."""
    measure = "_rules"
    while measure in docs.columns:
        measure += "_"
    _, stays = verdict(measure)
    return measured(docs, text, measure).where(stays).select(*(F.col(f"`{c}`") for c in docs.columns))
