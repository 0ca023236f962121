"""Raw Ethernet frames -> header columns, by fixed offsets in the Arrow buffer of a batch."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ETHERNET_BYTES, ICMP, IPIP, TCP, UDP

_IPV4_ETHERTYPE = 0x0800
_HEADER = (
    "ip_version int, proto int, src_ip bigint, dst_ip bigint, src_port int, dst_port int,"
    " frag_offset int, ip_len int, ttl int, tcp_flags int, icmp_type int, icmp_code int, payload_len int"
)


class _Frames:
    """Bytes of many frames side by side. A number is None-able: values and where they exist."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:][: len(column) + 1]
        data = column.buffers()[2]
        self.data = np.append(np.frombuffer(data, dtype=np.uint8) if data is not None else [], 0).astype(np.uint8)
        self.start, self.size = offsets[:-1], np.diff(offsets)

    def keep(self, rows: np.ndarray) -> None:
        self.start, self.size = self.start[rows], self.size[rows]

    def number(self, at, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Big-endian number at a byte of each frame, and whether the frame has all of it."""
        there = at + size <= self.size
        first = np.where(there, self.start + at, 0)
        value = np.zeros(len(first), dtype=np.int64)
        for i in range(size):
            value = value << 8 | self.data[np.minimum(first + i, len(self.data) - 1)]
        return np.where(there, value, 0), there


def _headers(batch: pa.RecordBatch, col: str, names: list[str]) -> pa.RecordBatch:
    f = _Frames(batch.column(col))
    rows = np.arange(batch.num_rows)

    def only(flags: np.ndarray) -> None:
        nonlocal rows
        f.keep(np.flatnonzero(flags))
        rows = rows[flags]

    kind, _ = f.number(12, 2)
    head, there = f.number(ETHERNET_BYTES, 1)
    only((kind == _IPV4_ETHERTYPE) & there & (head >> 4 == 4))
    outer, _ = f.number(ETHERNET_BYTES, 1)
    inside, _ = f.number(ETHERNET_BYTES + 9, 1)
    ip = ETHERNET_BYTES + np.where(inside == IPIP, (outer & 15) * 4, 0)
    head, there = f.number(ip, 1)
    inner = there & (head >> 4 == 4)
    only(inner)
    ip, head = ip[inner], (head[inner] & 15) * 4
    length, has_length = f.number(ip + 2, 2)
    middle, has_middle = f.number(ip + 6, 4)
    src, has_src = f.number(ip + 12, 4)
    dst, has_dst = f.number(ip + 16, 4)
    ports, has_ports = f.number(ip + head, 4)
    flags, has_flags = f.number(ip + head + 13, 1)
    proto, fragment = middle & 255, middle >> 16 & 0x1FFF
    first = has_middle & (fragment == 0)
    ported = first & np.isin(proto, (TCP, UDP))
    icmp = first & (proto == ICMP)

    def ints(values, there, kind=pa.int32()):
        return pa.array(values, kind, mask=~there)

    made = [
        pa.array(np.full(len(rows), 4), pa.int32()), ints(proto, has_middle), ints(src, has_src, pa.int64()), ints(dst, has_dst, pa.int64()),
        ints(np.where(ported, ports >> 16, 0), ~ported | has_ports), ints(np.where(ported, ports & 0xFFFF, 0), ~ported | has_ports),
        ints(fragment, has_middle), ints(length, has_length), ints(middle >> 8 & 255, has_middle),
        ints(flags, first & (proto == TCP) & has_flags),
        ints(ports >> 24, icmp & has_ports), ints(ports >> 16 & 255, icmp & has_ports), ints(length - head, has_length),
    ]
    others = [batch.column(n).take(pa.array(rows)) for n in names]
    return pa.RecordBatch.from_arrays(others + made, names=[*names, *(x.split()[0] for x in _HEADER.split(", "))])


def decode_frames(df: DataFrame, col: str = "frame") -> DataFrame:
    """Header columns of IPv4 frames; an IP-in-IP frame shows its inner packet.

    Other frames, and tunnels whose inner packet is not IPv4, drop out. Ports,
    flags and ICMP fields are read from first fragments only; fields that the
    capture cut off are NULL, ports of other protocols 0.
    """
    names = [c for c in df.columns if c != col]
    ddl = "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names) + _HEADER

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _headers(batch, col, names)

    return df.select(*names, F.col(col)).mapInArrow(decode, ddl)
