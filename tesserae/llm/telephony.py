"""Telephony audio: companded and ADPCM samples to linear PCM, resampled and stored.

Mu-law and A-law samples are expanded by lookup tables of 256 entries. ADPCM
(the 4-bit IMA kind, in blocks with a header of their own) is decoded one sample place at
a time for all blocks of a batch at once. PCM is brought to another rate by
linear interpolation in whole numbers, so results don't depend on the platform.
Media are RIFF/WAVE files of the codec, whose data chunk is the payload as it is. The resampled PCM is stored, and features
of the sound are computed from what was stored.

Defined results: a null payload counts as empty and becomes one block of zero
bytes; media that can't be parsed give null samples and features rather than a
failure; repeated rows get equal rows; an empty table gives an empty result;
other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, small_batches, stage

# RIFF format tags; IMA index adjustments by the three magnitude bits of a code; steps of the ADPCM scale.
FORMATS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
INDEX_STEPS = (-1, -1, -1, -1, 2, 4, 6, 8)
SCALE = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230,
    253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327,
    3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
BLOCK = 64
RATE = 8000


def mulaw_table() -> np.ndarray:
    """Linear values of the 256 mu-law bytes."""
    code = ~np.arange(256, dtype=np.uint8)
    exponent, mantissa = (code >> 4 & 7).astype(np.int32), (code & 15).astype(np.int32)
    value = ((2 * mantissa + 33) << (exponent + 2)) - 132
    return np.where(code & 128, -value, value).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear values of the 256 A-law bytes."""
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent, mantissa = (code >> 4 & 7).astype(np.int32), (code & 15).astype(np.int32)
    value = np.where(exponent == 0, (2 * mantissa + 1) << 3, (2 * mantissa + 33) << np.maximum(exponent + 2, 3))
    return np.where(code & 128, value, -value).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}
_INDEX_STEPS, _SCALE = np.array(INDEX_STEPS, np.int32), np.array(SCALE, np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks (one per row, mono): 1 + 2 * (width - 4) per block."""
    header = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel()
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = header
    value, index = header.astype(np.int32), np.minimum(blocks[:, 2], 88).astype(np.int32)
    for k, code in enumerate(codes):
        step, size = _SCALE[index], (code & 7).astype(np.int32)
        change = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + _INDEX_STEPS[size], 0, 88)
        out[k + 1] = value
    return np.ascontiguousarray(out.T)


def encode_adpcm(samples: np.ndarray, width: int = BLOCK) -> np.ndarray:
    """Blocks of IMA ADPCM for 16-bit samples, padded with the last sample; all blocks one sample place at a time."""
    per = 1 + 2 * (width - 4)
    fill = -len(samples) % per or (per if not len(samples) else 0)
    rows = np.append(samples, np.full(fill, samples[-1] if len(samples) else 0)).astype(np.int32).reshape(-1, per)
    slope = np.abs(rows[:, 1] - rows[:, 0])
    index = np.minimum(np.searchsorted(_SCALE, slope), 88).astype(np.int32)
    out = np.zeros((len(rows), width), np.uint8)
    out[:, :2] = rows[:, 0].astype("<i2").view(np.uint8).reshape(-1, 2)
    out[:, 2] = index
    value = rows[:, 0].copy()
    for k in range(1, per):
        step, gap = _SCALE[index], rows[:, k] - value
        size, left, change = np.zeros(len(rows), np.int32), np.abs(gap), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            fits = left >= part
            size, left, change = size | np.where(fits, bit, 0), left - np.where(fits, part, 0), change + np.where(fits, part, 0)
        value = np.clip(value + np.where(gap < 0, -change, change), -32768, 32767)
        index = np.clip(index + _INDEX_STEPS[size], 0, 88)
        code = (size | np.where(gap < 0, 8, 0)).astype(np.uint8)
        at = 4 + (k - 1) // 2
        out[:, at] |= code << (4 * ((k - 1) % 2))
    return out


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation at multiples of rate / to, in whole numbers, rounded half up."""
    n = len(samples) * to // rate
    at = np.arange(n, dtype=np.int64) * rate
    left = at // to
    right = np.minimum(left + 1, max(len(samples) - 1, 0))
    part = at - left * to
    wide = samples.astype(np.int64)
    return ((wide[left] * (to - part) + wide[right] * part + to // 2) // to).astype(np.int16) if n else np.zeros(0, np.int16)


def wave_file(payload: bytes, codec: str, rate: int = RATE, block: int = BLOCK) -> bytes:
    """A mono RIFF/WAVE file whose data chunk is the payload."""
    if codec == "adpcm":
        per = 1 + 2 * (block - 4)
        head = struct.pack("<HHIIHHHH", FORMATS[codec], 1, rate, rate * block // per, block, 4, 2, per)
    else:
        head = struct.pack("<HHIIHHH", FORMATS[codec], 1, rate, rate, 1, 8, 0)
    chunks = b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wave(media: bytes) -> tuple[str, int, int, bytes] | None:
    """Codec, rate, block size and payload of such a file; None if it isn't one."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, head = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if at + 8 + size > len(media):
            return None
        if name == b"fmt " and size >= 14:
            head = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data" and head is not None:
            codec = next((c for c, tag in FORMATS.items() if tag == head[0]), None)
            if codec is None or head[1] != 1 or not head[2] or (codec == "adpcm" and (head[4] < 5 or size % head[4])):
                return None
            return codec, head[2], head[4], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return None


def decode(codec: str, payload: bytes, block: int = BLOCK) -> np.ndarray:
    raw = np.frombuffer(payload, np.uint8)
    return TABLES[codec][raw] if codec in TABLES else decode_adpcm(raw.reshape(-1, block)).ravel()


def encode_media(rows: DataFrame, id_col: str, payload_col: str, codec: str | tuple[str, ...] = "mulaw", rate: int = RATE) -> DataFrame:
    """id, n_bytes, media: each payload, with zero bytes up to a positive multiple of 64, in a file of the codec.

    With several codecs, the payload's CRC-32 chooses one, so equal payloads get equal files.
    """
    codecs = (codec,) if isinstance(codec, str) else codec
    small_batches(rows.sparkSession)
    rows = rows.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))

    def wrap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raws = list(batch["payload"])
            media = [wave_file(p + b"\0" * (max(BLOCK, -len(p) // BLOCK * -BLOCK) - len(p)), codecs[zlib.crc32(p) % len(codecs)], rate) for p in raws]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "n_bytes": [len(p) for p in raws], "media": media})

    return rows.mapInPandas(wrap, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def decode_media(rows: DataFrame, id_col: str = "doc_id", media_col: str = "media", to: int = 16000, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, codec, rate, pcm: 16-bit little-endian samples at rate ``to``; null where the media can't be parsed."""
    small_batches(rows.sparkSession, 200)
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"), *keep)

    def unwrap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for media in batch["media"]:
                own = read_wave(bytes(media)) if media is not None else None
                out.append((own[0], own[1], resample(decode(own[0], own[3], own[2]), own[1], to).astype("<i2").tobytes()) if own else (None, None, None))
            told = pd.DataFrame(out, columns=["codec", "rate", "pcm"]).astype({"rate": "Int32"})
            yield pd.DataFrame(columns_of(batch, ["doc_id", *keep])).join(told)

    kept = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInPandas(unwrap, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}{kept}, codec string, rate int, pcm binary")


def store_pcm(media: DataFrame, path: str, to: int = 16000, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Write decoded, resampled PCM as Parquet at ``path`` and return what was stored."""
    decode_media(media, id_col, media_col, to).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return media.sparkSession.read.parquet(path)


READ_BACK = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, blocks_energy long, pcm binary"


def media_features(rows: DataFrame, id_col: str = "doc_id", media_col: str = "media", to: int = 16000, keep: tuple[str, ...] = ()) -> DataFrame:
    """Digests of the stored media and of the payload read back, and features of its sound, read from the PCM that is stored on the way.

    The feature names the codec, the samples at rate ``to``, their peak, energy (sum of squares),
    sign changes and CRC-32, and the energy of the payload decoded as ADPCM blocks.
    """
    small_batches(rows.sparkSession)
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"), *keep)

    def read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = [bytes(m) if m is not None else b"" for m in batch["media"]]
            parsed = [read_wave(m) for m in files]
            energy = _adpcm_energy([p[3] if p else b"" for p in parsed])
            out = []
            for media, own, blocks in zip(files, parsed, energy, strict=True):
                if own is None:
                    out.append((None, None, None, len(media), hashlib.sha256(media).hexdigest(), None, None, None))
                    continue
                codec, rate, block, payload = own
                pcm = resample(decode(codec, payload, block), rate, to)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), codec, blocks, lifted(pcm)))
            told = pd.DataFrame(out, columns=[c.split()[0] for c in READ_BACK.split(", ")])
            yield pd.DataFrame(columns_of(batch, ["doc_id", *keep])).join(told.astype({"payload_bytes": "Int64", "tail_crc32": "Int64", "blocks_energy": "Int64"}))

    def sound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["feature"] = [None if x is None else f"{c}:{_sound(unlifted(x))}:{int(e)}" for c, e, x in zip(batch["codec"], batch["blocks_energy"], batch["pcm"], strict=True)]
            yield batch.drop(columns=["pcm", "codec", "blocks_energy"])

    kept = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    id_and_kept = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}{kept}"
    stored = stage(rows.mapInPandas(read_back, f"{id_and_kept}, {READ_BACK}"), "telephony-pcm", 9)
    return stored.mapInPandas(sound, f"{id_and_kept}, {', '.join(READ_BACK.split(', ')[:5])}, feature string")


def _between(even: np.ndarray, n: int) -> np.ndarray:
    """The means of neighbours, rounded half up, for the n places after each one."""
    wide = even.astype(np.int32)
    return (wide[:n] + np.append(wide[1:], wide[-1:])[:n] + 1) >> 1


def lifted(samples: np.ndarray) -> bytes:
    """Samples of even places, then by how much each one in between differs from the mean of its neighbours (modulo 2^16): lossless, and what is smooth packs well."""
    even, odd = samples[0::2], samples[1::2]
    return even.astype("<i2").tobytes() + (odd.astype(np.int32) - _between(even, len(odd))).astype("<i2").tobytes()


def unlifted(stored: bytes) -> np.ndarray:
    """The samples that ``lifted`` was given."""
    values = np.frombuffer(stored, "<i2")
    even, rest = np.split(values, [(len(values) + 1) // 2])
    out = np.empty(len(values), "<i2")
    out[0::2], out[1::2] = even, (rest.astype(np.int32) + _between(even, len(rest))).astype("<i2")
    return out


def _sound(samples: np.ndarray) -> str:
    wide = samples.astype(np.int64)
    turns = int(((samples[1:] < 0) != (samples[:-1] < 0)).sum())
    return f"{len(samples)}:{int(np.abs(wide).max(initial=0))}:{int((wide * wide).sum())}:{turns}:{zlib.crc32(samples.tobytes()):08x}"


def _adpcm_energy(payloads: list[bytes], at_once: int = 1 << 16) -> list[int]:
    """Sum of squares of each payload read as 64-byte ADPCM blocks, decoded for all payloads together."""
    owner = np.repeat(np.arange(len(payloads)), [len(p) // BLOCK for p in payloads])
    raw = np.frombuffer(b"".join(p[: len(p) // BLOCK * BLOCK] for p in payloads), np.uint8).reshape(-1, BLOCK)
    total = np.zeros(len(payloads), np.int64)
    for k in range(0, len(raw), at_once):
        wide = decode_adpcm(raw[k : k + at_once]).astype(np.int64)
        np.add.at(total, owner[k : k + at_once], (wide * wide).sum(axis=1))
    return total.tolist()


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as the payload of A-law or mu-law media at 8 kHz, whose PCM is stored at 16 kHz: every sample plays a part, and every other one is interpolated."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    media = stage(encode_media(docs, "doc_id", "text", ("alaw", "mulaw"), rate=RATE), "telephony-media", 9)
    return media_features(media, to=2 * RATE, keep=("n_bytes",))


QUERIES = {"op1_telephony": op1_telephony}
ORACLES: dict[str, str] = {}
