"""Binary alignments against the same alignments as text, at any cut of the file."""

import random
import struct
import zlib

import pytest

from signalloom.sources import bam, text

REFS = [("1", 100_000), ("2", 50_000), ("X", 70_000)]


def bgzf(data, sizes):
    out, at = [], 0
    while at < len(data):
        n = sizes()
        raw, at = data[at : at + n], at + n
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(raw) + c.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(raw), len(raw)))
    out.append(bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000"))
    return b"".join(out)


def record(rng, i):
    """(binary record, SAM line)."""
    ref = rng.randrange(-1, 3)
    flag = 4 if ref < 0 else rng.choice((0, 16, 147, 1024, 99))
    pos = -1 if ref < 0 else rng.randrange(0, 40_000)
    steps = [] if ref < 0 else [(rng.randrange(1, 60), rng.choice("MIDNS=X")) for _ in range(rng.randrange(1, 5))]
    seq, name = sum(n for n, o in steps if o in "MIS=X"), f"read{i}".encode() + b"\0"
    cigar = struct.pack(f"<{len(steps)}I", *[n << 4 | "MIDNSHP=X".index(o) for n, o in steps])
    nm, x0 = rng.randrange(0, 200), rng.randrange(1, 4)
    tags = b"NMC" + struct.pack("<B", nm) + b"X0i" + struct.pack("<i", x0) + b"RGZgroup one\0" + b"XBBS" + struct.pack("<iHH", 2, 7, 8) + b"XAA" + b"q" + b"XFf" + struct.pack("<f", 1.5)
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), 30, 0, len(steps), flag, seq, -1, -1, 0) + name + cigar + bytes((seq + 1) // 2) + b"\xff" * seq + tags
    line = "\t".join(map(str, (f"read{i}", flag, REFS[ref][0] if ref >= 0 else "*", pos + 1, 30, "".join(f"{n}{o}" for n, o in steps) or "*", "*", 0, 0, "*", "*", f"NM:i:{nm}", f"X0:i:{x0}", "RG:Z:group one", "XA:A:q", "XF:f:1.5")))
    return struct.pack("<i", len(body)) + body, line


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng, folder = random.Random(3), tmp_path_factory.mktemp("bam")
    records = [record(rng, i) for i in range(3000)]
    head = b"@HD\tVN:1.6\n"
    data = b"BAM\x01" + struct.pack("<i", len(head)) + head + struct.pack("<i", len(REFS)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", length) for n, length in REFS)
    data += b"".join(r for r, _ in records)
    (folder / "a.bam").write_bytes(bgzf(data, lambda: rng.choice((700, 3000, 60_000))))
    (folder / "a.sam").write_text("@HD\n" + "".join(line + "\n" for _, line in records))
    (folder / "cut.bam").write_bytes((folder / "a.bam").read_bytes()[:20_000])
    (folder / "not.bam").write_bytes(b"plain text, and not a short one at all")
    return folder


@pytest.mark.parametrize("part", [64 << 20, 40_000, 9_000])
def test_records_are_those_of_the_text(spark, files, part):
    cols = ["qname", "flag", "ref", "pos", "mapq", "cigar", "strand", "fop_strand", "tags", "blocks"]
    key = lambda r: (r["qname"], str(r))
    got = sorted(bam.read_bam(spark, str(files / "a.bam"), part).select(*cols).collect(), key=key)
    assert got == sorted(text.read_sam(spark, str(files / "a.sam")).select(*cols).collect(), key=key) and len(got) > 2000


def test_signals_agree(spark, files):
    for kw in ({}, {"read_filter": "NM<100;STRAND=+"}, {"weight_by_x0": True}):
        a, b = (sorted((r["ref"], r["start1"], r["end1"], round(r["cov"], 9)) for r in text.read_signal(spark, str(files / f), **kw).collect()) for f in ("a.bam", "a.sam"))
        assert a == b and a


def test_broken_files(spark, files):
    for name in ("not.bam", "absent.bam"):
        with pytest.raises(ValueError):
            text.read_signal(spark, str(files / name))
    with pytest.raises(Exception, match="cut short|no BGZF|BGZF"):
        text.read_signal(spark, str(files / "cut.bam")).collect()
