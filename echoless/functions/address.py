"""Address columns: dotted text, numbers, masks, MAC bytes, block offsets."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ADDRESS_SPACE = 1 << 32


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def ip_to_int(c) -> Column:
    """Dotted quad -> number 0..2^32-1; anything else -> NULL."""
    parts = F.split(F.trim(_col(c)), r"\.")
    octet = [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(4)]
    valid = F.size(parts) == 4
    for o in octet:
        valid = valid & F.coalesce(o.between(0, 255), F.lit(False))
    number = octet[0] * 16777216 + octet[1] * 65536 + octet[2] * 256 + octet[3]
    return F.when(valid, number)


def int_to_ip(c) -> Column:
    ip = _col(c).cast("bigint")
    return F.concat_ws(".", *[
        F.shiftright(ip, shift).bitwiseAND(255).cast("string") for shift in (24, 16, 8, 0)
    ])


def mask_of(c) -> Column:
    """`24` or `255.255.255.0` -> mask number; out of range -> NULL."""
    text = F.trim(_col(c))
    bits = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    from_bits = F.when(
        bits.between(0, 32),
        F.lit(ADDRESS_SPACE) - F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(32) - bits),
    )
    return F.coalesce(from_bits, ip_to_int(text))


def mac_bytes(c) -> Column:
    return F.unhex(F.replace(_col(c), F.lit(":"), F.lit("")))


def mac_text(c) -> Column:
    pairs = F.lower(F.hex(_col(c)))
    return F.concat_ws(":", *[F.substring(pairs, 1 + 2 * i, 2) for i in range(6)])


def host_offset(c, base: int) -> Column:
    """Position of an address inside the /16 that starts at `base`, else NULL."""
    offset = _col(c) - F.lit(base)
    return F.when(offset.between(0, 65535), offset)
