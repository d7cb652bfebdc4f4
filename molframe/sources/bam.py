"""BAM files as DataFrames: blocks are verified and decompressed, records decoded, in one task per file; and DataFrames as BAM files, whose blocks are made in all tasks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.session import written

SCHEMA = "qname string, flag int, tid int, rname string, pos long, mapq int, ops array<struct<op:string,len:int>>, mate_tid int, mate_pos long, tlen long, seq string, qual array<int>, tags map<string,string>"
#: Bytes of records in a block.
BLOCK_BYTES = 65280
_BASES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def blocks(data: bytes, check: bool = True) -> Iterator[bytes]:
    """The contents of each block of a blocked gzip file; an error if one's checksum or length is wrong."""
    at = 0
    while at < len(data):
        extra = struct.unpack_from("<H", data, at + 10)[0]
        fields, size = data[at + 12 : at + 12 + extra], None
        while fields:
            kind, n = fields[:2], struct.unpack_from("<H", fields, 2)[0]
            if kind == b"BC":
                size = struct.unpack_from("<H", fields, 4)[0] + 1
            fields = fields[4 + n :]
        if data[at : at + 2] != b"\x1f\x8b" or size is None:
            raise ValueError("not a blocked gzip file")
        out = zlib.decompress(data[at + 12 + extra : at + size - 8], -15)
        crc, n = struct.unpack_from("<II", data, at + size - 8)
        if check and (zlib.crc32(out) != crc or len(out) != n):
            raise ValueError("a block's checksum is wrong")
        yield out
        at += size


def block(data: bytes) -> bytes:
    """One block of a blocked gzip file."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<HccHH", 6, b"B", b"C", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _tags(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            out[name], at = data[at:end].decode(), end + 1
        elif kind == "A":
            out[name], at = chr(data[at]), at + 1
        elif kind == "B":
            f, n = _NUMBERS[chr(data[at])], struct.unpack_from("<I", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{f}", data, at + 5)
            out[name], at = ",".join(map(str, values)), at + 5 + n * struct.calcsize(f)
        else:
            f = _NUMBERS[kind]
            out[name], at = str(struct.unpack_from(f"<{f}", data, at)[0]), at + struct.calcsize(f)
    return out


def records(data: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA of a decompressed BAM file."""
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    names, n = [], struct.unpack_from("<i", data, at)[0]
    at += 4
    for _ in range(n):
        k = struct.unpack_from("<i", data, at)[0]
        names.append(data[at + 4 : at + 3 + k].decode())
        at += 8 + k
    while at < len(data):
        size, tid, pos, l_name, mapq, _, n_ops, flag, l_seq, mate_tid, mate_pos, tlen = struct.unpack_from("<iiiBBHHHiiii", data, at)
        end, at = at + 4 + size, at + 36
        name, at = data[at : at + l_name - 1].decode(), at + l_name
        ops = [{"op": _OPS[x & 15], "len": x >> 4} for x in struct.unpack_from(f"<{n_ops}I", data, at)]
        at += 4 * n_ops
        packed, at = data[at : at + (l_seq + 1) // 2], at + (l_seq + 1) // 2
        seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq]
        qual = None if l_seq and data[at] == 0xFF else list(data[at : at + l_seq])
        yield name, flag, tid, names[tid] if tid >= 0 else None, pos, mapq, ops, mate_tid, mate_pos, tlen, seq, qual, _tags(data[at + l_seq : end])
        at = end


def read_bam(spark: SparkSession, path: str, check_crc: bool = True) -> DataFrame:
    """Records of BAM files; every file is one task's, so large files are better converted to Parquet once."""
    columns = [c.split(" ")[0] for c in SCHEMA.replace("array<struct<op:string,len:int>>", "x").split(", ")]

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for row in records(b"".join(blocks(bytes(content), check_crc))):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


def _tag_bytes(tags: dict[str, str] | None, kinds: dict[str, str] | None) -> bytes:
    """Tags by their kind (Z where none is known), in order of name."""
    out = b""
    for name in sorted(tags or {}):
        kind, value = (kinds or {}).get(name, "Z"), tags[name]
        if kind == "i":
            out += name.encode() + b"i" + struct.pack("<i", int(value))
        elif kind == "f":
            out += name.encode() + b"f" + struct.pack("<f", float(value))
        elif kind == "A":
            out += name.encode() + b"A" + value.encode()[:1]
        elif kind == "B":
            code, *values = value.split(",")
            out += name.encode() + b"B" + code.encode() + struct.pack(f"<I{len(values)}{_NUMBERS[code]}", len(values), *[float(v) if code == "f" else int(v) for v in values])
        else:
            out += name.encode() + kind.encode() + value.encode() + b"\0"
    return out


def bin_of(begin: int, end: int) -> int:
    """The smallest bin of the index scheme that holds 0-based begin to end."""
    end -= 1
    for shift, offset in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return offset + (begin >> shift)
    return 0


def record(row: dict, tids: dict[str, int]) -> bytes:
    """A row of SCHEMA (ops and tags as lists of pairs or maps; tag_types, where given, has the tags' kinds) as a BAM record."""
    ops = [(o["op"], o["len"]) for o in row["ops"]] if row["ops"] is not None else []
    seq, qual = row["seq"] or "", row["qual"]
    tid, pos = tids.get(row["rname"], -1), int(row["pos"]) if row["pos"] is not None else -1
    name = row["qname"].encode() + b"\0"
    packed = [_BASES.find(b) if b in _BASES else 15 for b in seq.upper()] + [0] * (len(seq) % 2)
    body = name + struct.pack(f"<{len(ops)}I", *[n << 4 | _OPS.index(op) for op, n in ops]) + bytes(a << 4 | b for a, b in zip(packed[::2], packed[1::2], strict=True))
    body += bytes(len(seq) * [0xFF]) if qual is None else bytes(int(q) for q in qual)
    tags = dict(row["tags"]) if row["tags"] is not None else None
    kinds = dict(row["tag_types"]) if row.get("tag_types") is not None else None
    body += _tag_bytes(tags, kinds)
    reach = sum(n for op, n in ops if op in "MDN=X") or 1
    head = struct.pack("<iiBBHHHiiii", tid, pos, len(name), row["mapq"], bin_of(max(pos, 0), max(pos, 0) + reach) if pos >= 0 else 4680, len(ops), row["flag"], len(seq), -1 if row["mate_tid"] is None else int(row["mate_tid"]), -1 if row["mate_pos"] is None else int(row["mate_pos"]), int(row["tlen"] or 0))
    return struct.pack("<i", len(head) + len(body)) + head + body


def header_text(text: str, program: dict[str, str] | None = None) -> str:
    """A header with a line for a program (ID, PN, VN, CL) that follows the last one there; an ID that is taken gets a number."""
    if program is None:
        return text
    lines = [x for x in text.split("\n") if x]
    ids = [f[3:] for x in lines if x.startswith("@PG") for f in x.split("\t") if f.startswith("ID:")]
    used = {f[3:] for x in lines if x.startswith("@PG") for f in x.split("\t") if f.startswith("PP:")}
    ends = [i for i in ids if i not in used]
    own, n = program["ID"], 0
    while own in ids:
        n += 1
        own = f"{program['ID']}.{n}"
    fields = [f"ID:{own}", *[f"{k}:{v}" for k, v in program.items() if k != "ID"], *([f"PP:{ends[-1]}"] if ends else [])]
    return "\n".join([*lines, "\t".join(["@PG", *fields])]) + "\n"


def bam_blocks(reads: DataFrame, references: dict[str, int]) -> DataFrame:
    """(part, nth, block binary): the reads as compressed blocks, made in each partition; in the order of part and nth they are the records in the order of the reads."""
    tids = {name: i for i, name in enumerate(references)}

    def run(batches):
        held, nth = b"", 0
        for pdf in batches:
            rows = []
            for row in pdf.drop(columns="part").to_dict("records"):
                held += record(row, tids)
                while len(held) >= BLOCK_BYTES:
                    rows.append((pdf["part"].iloc[0], nth, block(held[:BLOCK_BYTES])))
                    held, nth = held[BLOCK_BYTES:], nth + 1
            part = pdf["part"].iloc[0]
            yield pd.DataFrame(rows, columns=["part", "nth", "block"])
        if held:
            yield pd.DataFrame([(part, nth, block(held))], columns=["part", "nth", "block"])

    return reads.withColumn("part", F.spark_partition_id()).mapInPandas(run, "part int, nth long, block binary")


def write_bam(reads: DataFrame, path: str, references: dict[str, int], header: str = "") -> None:
    """One BAM file at a local path: a header, the blocks of all partitions in order, one partition at a time at the driver, and the empty last block."""
    text = header.encode()
    start = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(references))
    for name, size in references.items():
        start += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    with open(path, "wb") as out:
        for k in range(0, len(start), BLOCK_BYTES):
            out.write(block(start[k : k + BLOCK_BYTES]))
        for row in written(bam_blocks(reads, references), "blocks").orderBy("part", "nth").toLocalIterator():
            out.write(row["block"])
        out.write(block(b""))


def format_of(head: bytes) -> str:
    """bam, gzip, sam, fastq, fasta, vcf or text, by a file's first bytes (for bam at least a block's)."""
    if head[:2] == b"\x1f\x8b":
        try:
            start = zlib.decompressobj(31).decompress(head, 16)
        except zlib.error:
            start = b""
        return "bam" if start[:4] == b"BAM\x01" else "gzip"
    line = head.split(b"\n", 1)[0]
    if line.startswith(b"##fileformat=VCF"):
        return "vcf"
    if line.startswith(b">"):
        return "fasta"
    if line.startswith((b"@HD\t", b"@SQ\t", b"@RG\t", b"@PG\t", b"@CO\t")) or line.count(b"\t") >= 10:
        return "sam"
    return "fastq" if line.startswith(b"@") else "text"


def detect_format(spark: SparkSession, path: str, size: int = 1 << 16) -> str:
    """The format of a file on any file system that Spark reads, by its first bytes."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    n = min(size, files.getFileStatus(place).getLen())
    stream = files.open(place)
    try:
        return format_of(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)))
    finally:
        stream.close()
