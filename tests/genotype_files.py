"""Writers of small block-gzipped files with their tabix indexes, for tests."""

import struct
import zlib

EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_bgzf(path, data: bytes, size: int = 300) -> list[int]:
    """Blocks of ``size`` bytes, whatever the lines; the file places of the blocks."""
    places, at = [], 0
    with open(path, "wb") as f:
        for k in range(0, len(data), size):
            b = block(data[k : k + size])
            places.append(at)
            f.write(b)
            at += len(b)
        f.write(EOF)
    return [*places, at]


def region_bin(begin: int, end: int) -> int:
    """The smallest bin of the scheme that holds [begin, end)."""
    for first, shift in ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26)):
        if begin >> shift == end - 1 >> shift:
            return first + (begin >> shift)
    return 0


def write_vcf_gz(path, text: str, size: int = 300) -> None:
    data = text.encode()
    places = write_bgzf(path, data, size)
    virtual = lambda k: places[k // size] << 16 | k % size
    names, bins, linear, at = [], [], [], 0
    for line in data.splitlines(keepends=True):
        if not line.startswith(b"#"):
            chrom, pos = line.split(b"\t")[:2]
            begin, end = int(pos) - 1, int(pos) - 1 + len(line.split(b"\t")[3])
            if chrom not in names:
                names.append(chrom)
                bins.append({})
                linear.append([])
            own = bins[-1].setdefault(region_bin(begin, end), [])
            chunk = (virtual(at), virtual(at + len(line)) if at + len(line) < len(data) else places[-1] << 16)
            if own and own[-1][1] == chunk[0]:
                own[-1] = (own[-1][0], chunk[1])
            else:
                own.append(chunk)
            while len(linear[-1]) <= (end - 1) >> 14:
                linear[-1].append(chunk[0])
        at += len(line)
    joined = b"".join(n + b"\0" for n in names)
    out = b"TBI\x01" + struct.pack("<8i", len(names), 2, 1, 2, 0, 35, 0, len(joined)) + joined
    for own, low in zip(bins, linear, strict=True):
        out += struct.pack("<i", len(own))
        for number, chunks in own.items():
            out += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        out += struct.pack("<i", len(low)) + struct.pack(f"<{len(low)}Q", *low)
    write_bgzf(f"{path}.tbi", out, 60_000)


def typed(values, kind: str) -> bytes:
    """A typed value of a binary file: texts (``s``) or integers (``b``, ``h``, ``i``)."""
    code, data = (7, values.encode()) if kind == "s" else ({"b": 1, "h": 2, "i": 3}[kind], struct.pack(f"<{len(values)}{kind}", *values))
    n = len(values)
    return (bytes([n << 4 | code]) if n < 15 else bytes([0xF0 | code, 0x12]) + struct.pack("<h", n)) + data


def write_bcf(path, text: str, size: int = 300, wide: bool = False) -> None:
    """A VCF's records with genotypes, another format field and an INFO field, and a CSI index; ``wide``: genotypes of 16 bits."""
    lines = text.splitlines()
    own = [x.split("\t") for x in lines if not x.startswith("#")]
    contigs = list(dict.fromkeys(x[0] for x in own))
    head = [lines[0], *[f"##contig=<ID={c},length=999999999>" for c in contigs], '##FILTER=<ID=q10,Description="low">', '##INFO=<ID=NS,Number=1,Type=Integer,Description="n, of samples">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="g">', '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="d",IDX=9>', next(x for x in lines if x.startswith("#CHROM"))]
    joined = "\n".join(head).encode() + b"\n\0"
    data, spans = b"BCF\x02\x02" + struct.pack("<I", len(joined)) + joined, []
    for k, x in enumerate(own):
        alleles, samples = [x[3], *([] if x[4] == "." else x[4].split(","))], x[9:]
        shared = struct.pack("<iiifII", contigs.index(x[0]), int(x[1]) - 1, len(x[3]), 1.5, len(alleles) << 16 | 1, 2 << 24 | len(samples))
        shared += typed(x[2] if x[2] != "." else "", "s") + b"".join(typed(a, "s") for a in alleles) + typed([0], "b") + typed([2], "b") + typed([len(samples) + 300 * (k % 2)], "h")
        kind, end = ("h", -32767) if wide else ("b", -127)
        most = max(len(g.replace("|", "/").split("/")) for g in samples)
        codes = []
        for g in samples:
            parts = [((int(a) + 1) << 1 if a != "." else 0) | (j > 0 and "|" in g) for j, a in enumerate(g.replace("|", "/").split("/"))]
            codes += [*parts, *[end] * (most - len(parts))]
        body = typed([9], "b") + bytes([1 << 4 | 2]) + struct.pack(f"<{len(samples)}h", *range(len(samples)))
        body += typed([3], "b") + bytes([most << 4 | {"b": 1, "h": 2}[kind]]) + struct.pack(f"<{len(codes)}{kind}", *codes)
        record = struct.pack("<II", len(shared), len(body)) + shared + body
        spans.append((x[0], int(x[1]) - 1, int(x[1]) - 1 + len(x[3]), len(data), len(data) + len(record)))
        data += record
    places = write_bgzf(path, data, size)
    virtual = lambda k: places[k // size] << 16 | k % size if k < len(data) else places[-1] << 16
    bins: dict = {c: {} for c in contigs}
    for c, a, b, begin, end in spans:
        chunks = bins[c].setdefault(region_bin(a, b), [])
        if chunks and chunks[-1][1] == virtual(begin):
            chunks[-1] = (chunks[-1][0], virtual(end))
        else:
            chunks.append((virtual(begin), virtual(end)))
    levels = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))
    out = b"CSI\x01" + struct.pack("<4i", 14, 5, 0, len(contigs))
    for c in contigs:
        out += struct.pack("<i", len(bins[c]))
        for number, chunks in bins[c].items():
            first, bits = next(x for x in reversed(levels) if number >= x[0])
            low, high = (number - first) << bits, (number - first + 1) << bits
            least = min(virtual(begin) for d, a, b, begin, _ in spans if d == c and a < high and b > low)
            out += struct.pack("<IQi", number, least, len(chunks)) + b"".join(struct.pack("<QQ", *x) for x in chunks)
    write_bgzf(f"{path}.csi", out, 60_000)
