"""Activities from FIT files: one file a row, decoded where it lies; a damaged file is a row with an error.

The format is public: a header, records whose layout an earlier definition of their local type gives, in either byte
order, time stamps that may be shortened to five bits, a checksum; files may follow one another within a file.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds from 1970 to the format's epoch, and the least and greatest second that a start may be.
EPOCH, FIRST, LAST = 631_065_600, 631_152_000, 4_102_444_800
# Kinds of a field by their number: format and the value that stands for none.
KINDS = {0x00: ("B", 0xFF), 0x01: ("b", 0x7F), 0x02: ("B", 0xFF), 0x0A: ("B", 0), 0x0D: ("B", 0xFF), 0x83: ("h", 0x7FFF), 0x84: ("H", 0xFFFF), 0x8B: ("H", 0), 0x85: ("i", 0x7FFFFFFF), 0x86: ("I", 0xFFFFFFFF), 0x8C: ("I", 0), 0x88: ("f", None), 0x89: ("d", None), 0x8E: ("q", 2**63 - 1), 0x8F: ("Q", 2**64 - 1), 0x90: ("Q", 0)}
TEXT = 0x07
# Numbers of messages and fields.
FILE, SPORT, SESSION, RECORD, ACTIVITY = 0, 12, 18, 20, 34
TIME, START = 253, 2
MAKERS = {1: "garmin", 6: "srm", 7: "quarq", 9: "saris", 23: "suunto", 32: "wahoo_fitness", 69: "stages_cycling", 123: "polar_electro", 260: "zwift", 263: "favero_electronics", 265: "strava", 294: "coros"}
SPORTS = {0: "generic", 1: "running", 2: "cycling", 3: "transition", 4: "fitness_equipment", 5: "swimming", 10: "training", 11: "walking", 12: "cross_country_skiing", 15: "rowing", 17: "hiking"}

SAMPLE = "struct<t_s: double, power_w: double, heart_rate_bpm: double, speed_mps: double, cadence: double, altitude_m: double>"
FILES = f"path string, modified timestamp, bytes long, file_hash string, manufacturer string, product string, sport string, start_unix long, samples array<{SAMPLE}>, error string"
NAMES = ("t_s", "power_w", "heart_rate_bpm", "speed_mps", "cadence", "altitude_m")


class Damaged(ValueError):
    """A file that breaks the format."""


#: The checksum's steps for four bits at a time, by their rule.
def _nibble(v: int) -> int:
    for _ in range(4):
        v = (v >> 1) ^ (0xA001 if v & 1 else 0)
    return v


NIBBLES = [_nibble(v) for v in range(16)]


def checksum(data: bytes) -> int:
    c = 0
    for b in data:
        c = (c >> 4) ^ NIBBLES[(c ^ b) & 15]
        c = (c >> 4) ^ NIBBLES[(c ^ (b >> 4)) & 15]
    return c


def _value(raw: bytes, kind: int, order: str):
    """The first value of a field; None if it stands for none, or of a kind or size that isn't known."""
    if kind == TEXT:
        return raw.split(b"\0")[0].decode("utf-8", "replace") or None
    if kind not in KINDS:
        return None
    form, none = KINDS[kind]
    size = struct.calcsize(form)
    if len(raw) < size:
        return None
    v = struct.unpack(order + form, raw[:size])[0]
    return None if v == none or v != v else v


def messages(data: bytes) -> Iterator[tuple[int, dict[int, object]]]:
    """(number, values by field) of the messages of a file, fields without a value left out."""
    at = 0
    while at < len(data):
        head = data[at]
        if head < 12 or len(data) < at + head or data[at + 8 : at + 12] != b".FIT":
            raise Damaged("no header")
        end = at + head + struct.unpack_from("<I", data, at + 4)[0]
        if len(data) < end + 2:
            raise Damaged("cut short")
        if checksum(data[at:end]) != struct.unpack_from("<H", data, end)[0]:
            raise Damaged("wrong checksum")
        yield from _records(data, at + head, end)
        at = end + 2


def _records(data: bytes, at: int, end: int) -> Iterator[tuple[int, dict[int, object]]]:
    layouts: dict[int, tuple[int, str, list[tuple[int, int, int]], int]] = {}
    clock: int | None = None

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > end:
            raise Damaged("a record goes on beyond the data")
        at += n
        return data[at - n : at]

    while at < end:
        head = take(1)[0]
        if head & 0xC0 == 0x40:
            _, order, number, n = struct.unpack("<BBHB", take(5))
            order = ">" if order else "<"
            fields = [tuple(take(3)) for _ in range(n)]
            # fields of the makers' own follow the others
            own = sum(take(3)[1] for _ in range(take(1)[0])) if head & 0x20 else 0
            layouts[head & 15] = (number if order == "<" else number >> 8 | (number & 255) << 8, order, fields, own)
            continue
        local = (head >> 5) & 3 if head & 0x80 else head & 15
        if local not in layouts:
            raise Damaged("a record without a definition")
        number, order, fields, own = layouts[local]
        found = {}
        for k, size, kind in fields:
            v = _value(take(size), kind, order)
            if v is not None:
                found[k] = v
        take(own)
        if head & 0x80 and clock is not None:
            # the last five bits of the time, which goes on from the last one
            clock += ((head & 31) - clock) & 31
            found[TIME] = clock
        elif isinstance(found.get(TIME), int):
            clock = found[TIME]
        yield number, found


def _altitude(v) -> float | None:
    return None if v is None else v / 5 - 500 if isinstance(v, int) else float(v)


def _unix(v) -> int | None:
    u = v + EPOCH if isinstance(v, int) and v > 0 else None
    return u if u is not None and FIRST <= u <= LAST else None


def activity(data: bytes) -> dict:
    """What a file tells: manufacturer, product, sport, start_unix and samples. Times begin at 0 and never go back; a sample
    without a time comes a second after the one before it."""
    out: dict = {"manufacturer": None, "product": None, "sport": None, "start_unix": None}
    samples, last, t = [], None, 0.0
    for number, m in messages(data):
        if number == FILE:
            maker = m.get(1)
            out["manufacturer"] = MAKERS.get(maker, None if maker is None else str(maker))
            out["product"] = None if m.get(2) is None else str(m[2])
        elif number == SPORT and 0 in m:
            out["sport"] = SPORTS.get(m[0], str(m[0]))
        elif number in (SESSION, ACTIVITY):
            began, stamp = _unix(m.get(START)) if number == SESSION else None, _unix(m.get(TIME))
            out["start_unix"] = began or out["start_unix"] or stamp
        elif number == RECORD:
            now = m[TIME] + EPOCH if isinstance(m.get(TIME), int) else None
            if now is None:
                t = t + 1 if samples else 1.0
            elif last is None:
                t = 0.0
            else:
                t += max(now - last, 0)
            if now is not None:
                last = now
                out["start_unix"] = out["start_unix"] or now
            speed = m.get(73, m.get(6))
            altitude = _altitude(m.get(78))
            values = [m.get(7), m.get(3), speed / 1000 if isinstance(speed, int) else speed, m.get(4), altitude if altitude is not None else _altitude(m.get(2))]
            samples.append([t, *[None if v is None else float(v) for v in values]])
    if not samples:
        raise Damaged("no samples")
    first = samples[0][0]
    out["samples"] = [dict(zip(NAMES, [max(s[0] - first, 0.0), *s[1:]], strict=True)) for s in samples]
    return out


def fit_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, bytes, file_hash, manufacturer, product, sport, start_unix, samples, error) of the .fit files under path.

    A file that breaks the format, has a wrong checksum or no samples has an error, and no samples. A folder without such
    files gives no rows, as do files of no bytes, which Spark passes over. Each file is one row; its samples are one task's work.
    """
    names = FILES.split(", samples")[0].split(", ")

    def run(batches):
        for b in batches:
            rows = []
            for p, modified, n, content in zip(*[b.column(c).to_pylist() for c in ("path", "modificationTime", "length", "content")], strict=True):
                row = {"path": p, "modified": modified, "bytes": n, "file_hash": hashlib.sha256(content).hexdigest()}
                try:
                    row |= activity(content)
                except (Damaged, struct.error) as e:
                    row |= {"error": str(e)}
                rows.append(row)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"string": pa.string(), "timestamp": pa.timestamp("us", "UTC"), "long": pa.int64()}
    sample = pa.struct([(n, pa.float64()) for n in NAMES])
    schema = pa.schema([(n.split()[0], kinds[n.split()[1]]) for n in names] + [("samples", pa.list_(sample)), ("error", pa.string())])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[fF][iI][tT]").load(path)
    return files.select("path", "modificationTime", "length", "content").mapInArrow(run, FILES)


def fit_samples(files: DataFrame) -> DataFrame:
    """The samples of fit_files, in the columns of readers.activities; activity_id is the file's name without its ending."""
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return files.select(name.alias("activity_id"), F.explode("samples").alias("s")).select("activity_id", "s.*")
