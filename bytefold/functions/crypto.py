"""Key derivation and verification.

AES-CBC checks use Spark's own ``try_aes_decrypt``.  HMAC-based derivations have no built-in; they
run as Arrow batches through ``hmac``.  Ciphers that neither Spark nor this installation has are
refused by name instead of being guessed at.
"""

from __future__ import annotations

import hashlib
import hmac
import struct
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from bytefold.functions.plugins import import_modules

# Defaults of a decryption check.
CHECK_IV = bytes(range(16))

UNSUPPORTED = ("xchacha20-poly1305", "argon2id", "x25519", "ml-kem", "hkdf-blake3")


def verifies(key: Column, ciphertext: Column, expected: Column, iv: bytes = CHECK_IV) -> Column:
    """Whether AES-256-CBC with PKCS padding under ``key`` gives the expected plaintext.

    Null for a key that isn't 32 bytes long: not tried rather than false.
    """
    plain = F.try_aes_decrypt(F.concat(F.lit(iv), ciphertext), key, F.lit("CBC"), F.lit("PKCS"))
    return F.when(F.octet_length(key) == 32, F.coalesce(plain == expected, F.lit(False)))


def encrypt(key: Column, plain: Column, iv: bytes = CHECK_IV) -> Column:
    """AES-CBC ciphertext without the vector Spark puts in front."""
    return F.substring(F.aes_encrypt(plain, key, F.lit("CBC"), F.lit("PKCS"), F.lit(iv)), F.lit(17), F.lit(2_147_483_647))


def tls12_prf(secret: bytes, label: bytes, seed: bytes, length: int, algo: str = "sha256") -> bytes:
    """The TLS 1.2 pseudo-random function (RFC 5246, section 5)."""
    seed, out = label + seed, b""
    a = seed
    while len(out) < length:
        a = hmac.digest(secret, a, algo)
        out += hmac.digest(secret, a + seed, algo)
    return out[:length]


def tls12_master_secret(pre_master: bytes, client_random: bytes, server_random: bytes, algo: str = "sha256") -> bytes:
    return tls12_prf(pre_master, b"master secret", client_random + server_random, 48, algo)


def tls12_key_block(master: bytes, server_random: bytes, client_random: bytes, length: int, algo: str = "sha256") -> bytes:
    return tls12_prf(master, b"key expansion", server_random + client_random, length, algo)


def hkdf_extract(salt: bytes, material: bytes, algo: str = "sha256") -> bytes:
    """RFC 5869; an empty salt is one block of zeros."""
    return hmac.digest(salt or bytes(hashlib.new(algo).digest_size), material, algo)


def hkdf_expand(key: bytes, info: bytes, length: int, algo: str = "sha256") -> bytes:
    if length > 255 * hashlib.new(algo).digest_size:
        raise ValueError("too many bytes asked of HKDF")
    out, block, i = b"", b"", 0
    while len(out) < length:
        i += 1
        block = hmac.digest(key, block + info + bytes([i]), algo)
        out += block
    return out[:length]


def hkdf_expand_label(secret: bytes, label: str, context: bytes, length: int, algo: str = "sha256") -> bytes:
    """TLS 1.3 (RFC 8446, section 7.1)."""
    full = b"tls13 " + label.encode()
    return hkdf_expand(secret, struct.pack(">HB", length, len(full)) + full + bytes([len(context)]) + context, length, algo)


def derive_secret(secret: bytes, label: str, transcript_hash: bytes, algo: str = "sha256") -> bytes:
    return hkdf_expand_label(secret, label, transcript_hash, hashlib.new(algo).digest_size, algo)


def ssh_mpint(value: bytes) -> bytes:
    """A length-prefixed integer that stays positive (RFC 4251, section 5)."""
    if value[:1] >= b"\x80":
        value = b"\0" + value
    return len(value).to_bytes(4, "big") + value


def ssh_key(shared: bytes, exchange: bytes, letter: str, session: bytes, length: int, algo: str = "sha256") -> bytes:
    """One SSH-2 key (RFC 4253, section 7.2)."""
    head = ssh_mpint(shared) + exchange
    out = hashlib.new(algo, head + letter.encode() + session).digest()
    while len(out) < length:
        out += hashlib.new(algo, head + out).digest()
    return out[:length]


# Names of the six SSH-2 keys and the labels of TLS 1.3 secrets.
SSH_KEYS = {"A": "SSH2_IV_CS", "B": "SSH2_IV_SC", "C": "SSH2_ENCRYPTION_KEY_CS", "D": "SSH2_ENCRYPTION_KEY_SC", "E": "SSH2_INTEGRITY_KEY_CS", "F": "SSH2_INTEGRITY_KEY_SC"}
TLS13_LABELS = ("derived", "c hs traffic", "s hs traffic", "c ap traffic", "s ap traffic", "exp master", "res master")
TLS13_TRAFFIC = ("CLIENT_HANDSHAKE_TRAFFIC_SECRET", "SERVER_HANDSHAKE_TRAFFIC_SECRET", "CLIENT_TRAFFIC_SECRET_0", "SERVER_TRAFFIC_SECRET_0")
LINK_CONFIDENCE = 0.95


@dataclass(frozen=True)
class Derivation:
    """A key derivation scheme: the secrets it expands, and how."""

    name: str
    protocol: str
    secret_types: tuple[str, ...]
    expand: Callable[[str, bytes, str], list[tuple[str, bytes]]]


DERIVATIONS: dict[str, Derivation] = {}


def derivation(name: str, protocol: str, secret_types: tuple[str, ...]):
    """Register a function ``(type, value, hash) -> [(type, value)]`` as a scheme."""

    def add(fn):
        DERIVATIONS[name] = Derivation(name, protocol, tuple(secret_types), fn)
        return fn

    return add


def discover_derivations(package: str, prefix: str = "kdf_") -> list[str]:
    """Import a package's modules of schemes; the names that are new."""
    before = set(DERIVATIONS)
    import_modules(package, prefix)
    return sorted(set(DERIVATIONS) - before)


def schemes_of(protocol: str) -> list[Derivation]:
    return [d for d in DERIVATIONS.values() if d.protocol.upper() == protocol.upper()]


def supports(kind: Column, protocol: str | None = None) -> Column:
    """Whether a secret's type is one that a registered scheme (of a protocol) expands."""
    known = sorted({t for d in DERIVATIONS.values() if protocol is None or d.protocol.upper() == protocol.upper() for t in d.secret_types})
    return kind.isin(known)


def expand_secret(kind: str, value: bytes, algo: str = "sha256") -> list[tuple[str, bytes]]:
    """Secrets that follow from one by the first registered scheme for its type."""
    return next((d.expand(kind, value, algo) for d in DERIVATIONS.values() if kind in d.secret_types), [])


@derivation("tls13", "TLS", TLS13_TRAFFIC)
def _expand_tls13(kind: str, value: bytes, algo: str = "sha256") -> list[tuple[str, bytes]]:
    """A traffic secret's keys of 16 and 32 bytes, vector and finished key."""
    sizes = [(f"_KEY_{8 * n}", "key", n) for n in (16, 32)] + [("_IV", "iv", 12), ("_FINISHED", "finished", hashlib.new(algo).digest_size)]
    return [(kind + suffix, hkdf_expand_label(value, label, b"", n, algo)) for suffix, label, n in sizes]


@derivation("ssh2", "SSH", ("SSH2_SESSION_KEY",))
def _expand_ssh(kind: str, value: bytes, algo: str = "sha256") -> list[tuple[str, bytes]]:
    """A session key's six SSH keys, with zeros for the unknown exchange hash and session."""
    return [(name, ssh_key(value, bytes(32), letter, bytes(32), 32, algo)) for letter, name in SSH_KEYS.items()]


def _version(protocol: str) -> str:
    """One spelling of a protocol's version: ``12``, ``13`` or ``2``; another is given back as it is."""
    return {"TLS12": "12", "TLS13": "13", "SSH2": "2"}.get(protocol.upper(), protocol)


def derived(value: bytes, protocol: str, algo: str = "sha256") -> list[bytes]:
    """What a candidate derives to on its own under a protocol's scheme, with zeros for what isn't known."""
    zeros = bytes(32)
    if _version(protocol) == "12":
        return [tls12_master_secret(value, zeros, zeros, algo)]
    if _version(protocol) == "13":
        return [hkdf_expand_label(value, label, zeros, 32, algo) for label in TLS13_LABELS]
    return []


def joined(a: bytes, b: bytes, protocol: str, algo: str = "sha256") -> bool:
    """Whether two candidates together derive to one of them (extraction in TLS 1.3, the keys of SSH 2)."""
    both = ((a, b), (b, a))
    if _version(protocol) == "13":
        return any(hkdf_extract(x, y, algo) in (a, b) for x, y in both)
    if _version(protocol) == "2":
        return any(ssh_key(x, y, letter, y, 32, algo) in (a, b) for letter in SSH_KEYS for x, y in both)
    return False


def joins(protocol: str) -> bool:
    """Whether a protocol's scheme derives from two candidates at once."""
    return _version(protocol) in ("13", "2")


def linked(a: bytes, b: bytes, protocol: str, algo: str = "sha256") -> float:
    """Confidence that one of two candidates derives from the other under a protocol's scheme."""
    return LINK_CONFIDENCE if a in derived(b, protocol, algo) or b in derived(a, protocol, algo) or joined(a, b, protocol, algo) else 0.0


PROBE_CONFIDENCE = 0.70


def probe(value: bytes, protocol: str, size: int, algo: str = "sha256") -> bytes:
    """What a candidate would derive to with zeros for all that is unknown."""
    version, zeros = protocol.upper(), bytes(size)
    if version in ("TLS12", "12"):
        return tls12_master_secret(value, bytes(32), bytes(32), algo)
    if version in ("TLS13", "13"):
        return hkdf_extract(zeros, value, algo)
    return ssh_key(value, zeros, "A", zeros, size, algo)


#: Size of a protocol's candidates in bytes; both spellings of a version are known.
KEY_SIZES = {"TLS12": 48, "12": 48, "TLS13": 32, "13": 32, "SSH2": 32, "2": 32}


def require(cipher: str) -> None:
    """Refuse what can't be done here, by name."""
    if cipher.lower() in UNSUPPORTED:
        raise NotImplementedError(f"{cipher} is not available in this installation")
