"""Values that big checksums prove: wallet addresses, onion services, IPv6 addresses.

Candidates are found inside the JVM, as an array like that of detect.mentions(). Only they, not the texts, reach the
one Arrow-fed function that checks them and gives their normal forms.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checksums import BASE58, BECH32, base58_version, base58_versions, bech32_witness, onion_label

# Shapes of addresses, version bytes, generator and prefix of CashAddr, networks of Monero and their lengths.
SHAPES = (
    ("legacy", r"(?<![A-Za-z0-9])([13LMD9A][1-9A-HJ-NP-Za-km-z]{25,34})(?![A-Za-z0-9])", ""),
    ("bc", r"(?i)(?<![A-Za-z0-9])(bc1[02-9ac-hj-np-z]{6,87})(?![A-Za-z0-9])", ""),
    ("ltc", r"(?i)(?<![A-Za-z0-9])(ltc1[02-9ac-hj-np-z]{6,87})(?![A-Za-z0-9])", ""),
    ("bch", r"(?i)(?<![A-Za-z0-9:])((?:bitcoincash:)?[qp][02-9ac-hj-np-z]{41})(?![A-Za-z0-9])", ""),
    ("xmr", r"(?<![A-Za-z0-9])([48][1-9A-HJ-NP-Za-km-z]{94}(?:[1-9A-HJ-NP-Za-km-z]{11})?)(?![A-Za-z0-9])", ""),
    ("eth", r"(?<![A-Za-z0-9])(0x[0-9a-fA-F]{40})(?![A-Za-z0-9])", "0x"),
    ("onion", r"(?i)(?<![a-z2-7])([a-z2-7]{56})\.onion(?![\w\-])", "nion"),
    ("ipv6", r"(?U)(?<![\w:.])((?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?![\w:.])", ":"),
    ("ipv6", r"\[([0-9A-Fa-f:.]{2,45})\]", "["),
)
LEGACY = {0x00: "btc", 0x05: "btc", 0x30: "ltc", 0x32: "ltc", 0x1E: "doge", 0x16: "doge"}
CASHADDR, CASHADDR_GENERATOR = "bitcoincash", (0x98F2BC8E61, 0x79B76D99E2, 0xF33E5FB3C4, 0xAE2EABE2A8, 0x1E4F43E470)
MONERO = {18: 69, 19: 77, 42: 69}
MONERO_BLOCK = {2: 1, 3: 2, 5: 3, 6: 4, 7: 5, 9: 6, 10: 7, 11: 8}
KECCAK_RATE = 136

_ALL = (1 << 64) - 1


def _tables() -> tuple[list[tuple[int, int]], list[int]]:
    """(lane, rotation) along the walk of the permutation, and the round constants, both from their rules."""
    walk, x, y = [], 1, 0
    for t in range(24):
        walk.append((x + 5 * y, (t + 1) * (t + 2) // 2 % 64))
        x, y = y, (2 * x + 3 * y) % 5
    constants, register = [], 1
    for _ in range(24):
        value = 0
        for j in range(7):
            value |= (register & 1) << ((1 << j) - 1)
            register = register << 1 ^ (0x171 if register & 0x80 else 0)
        constants.append(value)
    return walk, constants


_WALK, _CONSTANTS = _tables()


def _turn(v: int, n: int) -> int:
    return (v << n | v >> (64 - n)) & _ALL


def keccak256(data: bytes) -> bytes:
    """Keccak-256 with the original padding, which the SHA-3 of the standard library does not have."""
    padded = bytearray(data) + b"\x01" + bytes(-(len(data) + 1) % KECCAK_RATE)
    padded[-1] |= 0x80
    lanes = [0] * 25
    for at in range(0, len(padded), KECCAK_RATE):
        for i in range(KECCAK_RATE // 8):
            lanes[i] ^= int.from_bytes(padded[at + 8 * i : at + 8 * i + 8], "little")
        for constant in _CONSTANTS:
            column = [lanes[x] ^ lanes[x + 5] ^ lanes[x + 10] ^ lanes[x + 15] ^ lanes[x + 20] for x in range(5)]
            lanes = [v ^ column[(i - 1) % 5] ^ _turn(column[(i + 1) % 5], 1) for i, v in enumerate(lanes)]
            carried = lanes[1]
            for k, (_, rotation) in enumerate(_WALK):
                to = _WALK[(k + 1) % 24][0]
                lanes[to], carried = _turn(carried, rotation), lanes[to]
            lanes = [v ^ (~lanes[i - i % 5 + (i + 1) % 5] & lanes[i - i % 5 + (i + 2) % 5]) for i, v in enumerate(lanes)]
            lanes[0] ^= constant
    return b"".join(v.to_bytes(8, "little") for v in lanes[:4])


def eth(text: str) -> str | None:
    """An address of one case, or one whose upper-case letters are where the digest of its lower case has high nibbles."""
    body = text[2:]
    if body not in (body.lower(), body.upper()):
        digest = keccak256(body.lower().encode()).hex()
        if any(c.isalpha() and c.isupper() != (d > "7") for c, d in zip(body, digest)):
            return None
    return text.lower()


def cashaddr(text: str) -> str | None:
    low = text.lower()
    if text not in (low, text.upper()):
        return None
    body, check = low.rpartition(":")[2], 1
    for v in [ord(c) % 32 for c in CASHADDR] + [0] + [BECH32.index(c) for c in body]:
        top, check = check >> 35, (check % (1 << 35)) << 5 ^ v
        for i, g in enumerate(CASHADDR_GENERATOR):
            check ^= g * (top >> i & 1)
    return f"{CASHADDR}:{body}" if check == 1 else None


def monero(text: str) -> str | None:
    """Blocks of 8 bytes are 11 characters; a shorter last one has the characters of MONERO_BLOCK."""
    raw = b""
    for part in (text[i : i + 11] for i in range(0, len(text), 11)):
        size, number = MONERO_BLOCK.get(len(part)), 0
        for c in part:
            number = number * 58 + BASE58.index(c)
        if size is None or number >> (8 * size):
            return None
        raw += number.to_bytes(size, "big")
    return text if MONERO.get(raw[0]) == len(raw) and keccak256(raw[:-4])[:4] == raw[-4:] else None


def ipv6(text: str) -> tuple[str, bool] | None:
    """The address in its short form, and whether it is of a private, reserved, loopback or link-local range."""
    try:
        a = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    return str(a), a.is_private or a.is_reserved or a.is_loopback or a.is_link_local


def proved(shape: str, raw: str) -> tuple[str, str, bool | None] | None:
    """(type, normalized, private) of a candidate of a shape, or nothing if its checksum fails."""
    if shape == "legacy":
        kind = LEGACY.get(base58_version(raw))
        return (kind, raw, None) if kind else None
    if shape in ("bc", "ltc"):
        return ("btc" if shape == "bc" else shape, raw.lower(), None) if bech32_witness(raw, shape) is not None else None
    if shape == "onion":
        return (shape, f"{raw.lower()}.onion", None) if onion_label(raw.lower()) else None
    if shape == "ipv6":
        found = ipv6(raw)
        return (shape, *found) if found else None
    normal = {"bch": cashaddr, "xmr": monero, "eth": eth}[shape](raw)
    return (shape, normal, None) if normal else None


FOUND = "array<struct<type:string,raw:string,normalized:string,private:boolean>>"


_FOUND = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("type", T.StringType()), ("raw", T.StringType()), ("normalized", T.StringType()), ("private", T.BooleanType()))]))


@F.pandas_udf(_FOUND)
def prove(found: pd.Series) -> pd.Series:
    """The candidates of each row that are proved. Base-58 ones of all rows of a batch are converted together."""
    found = [[] if r is None else list(r) for r in found]
    legacy = sorted({c["raw"] for r in found for c in r if c["shape"] == "legacy"})
    version = dict(zip(legacy, base58_versions(legacy)))

    def one(c) -> tuple | None:
        if c["shape"] == "legacy":
            kind = LEGACY.get(version[c["raw"]])
            return (kind, c["raw"], None) if kind else None
        return proved(c["shape"], c["raw"])

    return pd.Series([[{"type": p[0], "raw": c["raw"], "normalized": p[1], "private": p[2]} for c in r if (p := one(c))] for r in found])


def _shaped(shape: str, pattern: str, text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(shape).alias("shape"), x.alias("raw")))


def candidates(text: Column) -> Column:
    """ARRAY<STRUCT<shape, raw>> of what has the shape of an address; empty for a null text."""
    none = F.expr("cast(array() as array<struct<shape:string,raw:string>>)")
    found = []
    for shape, pattern, hint in SHAPES:
        rows = _shaped(shape, pattern, text)
        found.append(F.coalesce(F.when(text.contains(hint), rows) if hint else rows, none))
    return F.flatten(F.array(*found))


def proved_mentions(text: Column) -> Column:
    """ARRAY<STRUCT<type, raw, normalized, private>> of the proved addresses of a text; only candidates go through Python."""
    return prove(candidates(text))


def addresses(rows: DataFrame, text: str = "text") -> DataFrame:
    """All other columns of rows, and type, raw, normalized and private of each proved address of the text."""
    others = [c for c in rows.columns if c != text]
    some = rows.select(*others, candidates(F.col(text)).alias("__c")).where(F.size("__c") > 0)
    return some.select(*others, F.explode(prove("__c")).alias("__p")).select(*others, "__p.*")
