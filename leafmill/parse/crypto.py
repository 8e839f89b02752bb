"""The standard security handler: RC4 and AES keys, passwords, and data of objects."""

from __future__ import annotations

import hashlib
import os
from functools import cache, lru_cache

from leafmill.parse.tokens import Name, PdfError

#: Fixed value: what passwords are filled up with.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for c in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(c ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def _times(a: int, b: int) -> int:
    """A product in the field that AES computes in."""
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


@cache
def _boxes() -> tuple[list[int], list[int], dict[int, list[int]]]:
    """Substitution, its inverse, and products by the factors of the mixing steps, from their definition."""
    inverse = [0] * 256
    for a in range(1, 256):
        if not inverse[a]:
            b = next(b for b in range(1, 256) if _times(a, b) == 1)
            inverse[a], inverse[b] = b, a
    box = []
    for a in range(256):
        b = inverse[a]
        box.append((b ^ b << 1 ^ b >> 7 ^ b << 2 ^ b >> 6 ^ b << 3 ^ b >> 5 ^ b << 4 ^ b >> 4) & 255 ^ 0x63)
    back = [0] * 256
    for a, b in enumerate(box):
        back[b] = a
    return box, back, {f: [_times(a, f) for a in range(256)] for f in (2, 3, 9, 11, 13, 14)}


@lru_cache(64)
def _schedule(key: bytes) -> list[list[int]]:
    box, _, _ = _boxes()
    n, words, turn = len(key) // 4, [list(key[i : i + 4]) for i in range(0, len(key), 4)], 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = [box[b] for b in w[1:] + w[:1]]
            w[0] ^= turn
            turn = _times(turn, 2)
        elif n > 6 and i % n == 4:
            w = [box[b] for b in w]
        words.append([a ^ b for a, b in zip(words[i - n], w)])
    return [sum(words[i : i + 4], []) for i in range(0, len(words), 4)]


@cache
def _columns() -> tuple[list[int], ...]:
    """Substitution and mixing of one byte in each row of a column, as 32-bit numbers."""
    box, _, by = _boxes()
    first = [by[2][x] << 24 | x << 16 | x << 8 | by[3][x] for x in box]
    return tuple([t >> 8 * r | (t << (32 - 8 * r) & 0xFFFFFFFF) for t in first] for r in range(4))


@lru_cache(64)
def _words(key: bytes) -> list[tuple[int, ...]]:
    return [tuple(int.from_bytes(bytes(k[i : i + 4])) for i in range(0, 16, 4)) for k in _schedule(key)]


def _encrypt_word(keys: list[tuple[int, ...]], block: int) -> int:
    """One block as a number of 128 bits."""
    t0, t1, t2, t3 = _columns()
    box = _boxes()[0]
    k = keys[0]
    a, b, c, d = block >> 96 ^ k[0], block >> 64 & 0xFFFFFFFF ^ k[1], block >> 32 & 0xFFFFFFFF ^ k[2], block & 0xFFFFFFFF ^ k[3]
    for k in keys[1:-1]:
        a, b, c, d = (
            t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k[0],
            t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k[1],
            t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k[2],
            t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k[3],
        )
    out = 0
    for (w, x, y, z), key in zip(((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c)), keys[-1]):
        out = out << 32 | (box[w >> 24] << 24 | box[x >> 16 & 255] << 16 | box[y >> 8 & 255] << 8 | box[z & 255]) ^ key
    return out


def _decrypt_block(keys: list[list[int]], block: list[int]) -> list[int]:
    _, back, by = _boxes()
    s = [a ^ b for a, b in zip(block, keys[-1])]
    for n in range(len(keys) - 2, -1, -1):
        s = [back[s[(i - 4 * (i % 4)) % 16]] for i in range(16)]
        s = [a ^ b for a, b in zip(s, keys[n])]
        if n:
            s = [by[14][s[i]] ^ by[11][s[i & 12 | (i + 1) & 3]] ^ by[13][s[i & 12 | (i + 2) & 3]] ^ by[9][s[i & 12 | (i + 3) & 3]] for i in range(16)]
    return s


def aes_cbc_encrypt(key: bytes, iv: bytes, data: bytes, pad: bool = True) -> bytes:
    if pad:
        n = 16 - len(data) % 16
        data += bytes([n]) * n
    keys, last, out = _words(key), int.from_bytes(iv), bytearray()
    for at in range(0, len(data), 16):
        last = _encrypt_word(keys, int.from_bytes(data[at : at + 16]) ^ last)
        out += last.to_bytes(16)
    return bytes(out)


def aes_cbc_decrypt(key: bytes, iv: bytes, data: bytes, pad: bool = True) -> bytes:
    keys, last, out = _schedule(key), iv, bytearray()
    for at in range(0, len(data) - 15, 16):
        block = data[at : at + 16]
        out += bytes(a ^ b for a, b in zip(_decrypt_block(keys, list(block)), last))
        last = block
    return bytes(out[: -out[-1]] if pad and out and 1 <= out[-1] <= 16 else out)


def _hash6(password: bytes, salt: bytes, user: bytes) -> bytes:
    """The hardened hash of revision 6."""
    k, i, last = hashlib.sha256(password + salt + user).digest(), 0, 0
    while i < 64 or last > i - 32:
        e = aes_cbc_encrypt(k[:16], k[16:32], (password + k + user) * 64, pad=False)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        last, i = e[-1], i + 1
    return k[:32]


class Security:
    """The handler of one document; ``key`` is set once a password was right."""

    def __init__(self, encrypt: dict, doc_id: bytes):
        if encrypt.get("Filter") != "Standard":
            raise PdfError("UnsupportedFilter", "another security handler")
        self.v, self.r, self.p = encrypt.get("V", 0), encrypt.get("R", 2), encrypt.get("P", 0)
        self.o, self.u = bytes(encrypt["O"]), bytes(encrypt["U"])
        self.oe, self.ue = bytes(encrypt.get("OE", b"")), bytes(encrypt.get("UE", b""))
        self.doc_id, self.plain_metadata = doc_id, encrypt.get("EncryptMetadata") is False
        self.length = 5 if self.v == 1 else encrypt.get("Length", 40 if self.v < 4 else 128) // 8
        method = "V2"
        if self.v >= 4:
            method = encrypt.get("CF", {}).get(encrypt.get("StmF", "StdCF"), {}).get("CFM", "V2" if self.v == 4 else "AESV3")
            self.length = 16 if self.v == 4 else 32
        self.aes = method in ("AESV2", "AESV3")
        self.key: bytes | None = None

    def _user_key(self, password: bytes) -> bytes:
        data = (password + PAD)[:32] + self.o[:32] + (self.p & 0xFFFFFFFF).to_bytes(4, "little") + self.doc_id
        key = hashlib.md5(data + b"\xff\xff\xff\xff" * (self.plain_metadata and self.r >= 4)).digest()
        for _ in range(50 * (self.r >= 3)):
            key = hashlib.md5(key[: self.length]).digest()
        return key[: self.length]

    def _user_check(self, key: bytes) -> bytes:
        if self.r == 2:
            return rc4(key, PAD)
        out = rc4(key, hashlib.md5(PAD + self.doc_id).digest())
        for i in range(1, 20):
            out = rc4(bytes(k ^ i for k in key), out)
        return out

    def _owner_key(self, password: bytes) -> bytes:
        key = hashlib.md5((password + PAD)[:32]).digest()
        for _ in range(50 * (self.r >= 3)):
            key = hashlib.md5(key).digest()
        return key[: self.length]

    def authenticate(self, password: str) -> str | None:
        """``user``, ``owner`` or None; the user's password is tried first."""
        if self.r >= 5:
            return self._authenticate5(password.encode()[:127])
        raw = password.encode("latin-1", "replace")
        n = 32 if self.r == 2 else 16
        key = self._user_key(raw)
        if self._user_check(key)[:n] == self.u[:n]:
            self.key = key
            return "user"
        owner, user = self._owner_key(raw), self.o[:32]
        for i in range(19 if self.r >= 3 else 0, -1, -1):
            user = rc4(bytes(k ^ i for k in owner), user)
        key = self._user_key(user)
        if self._user_check(key)[:n] == self.u[:n]:
            self.key = key
            return "owner"
        return None

    def _authenticate5(self, raw: bytes) -> str | None:
        digest = _hash6 if self.r >= 6 else lambda p, salt, user: hashlib.sha256(p + salt + user).digest()
        for who, check, user, sealed in (("user", self.u, b"", self.ue), ("owner", self.o, self.u[:48], self.oe)):
            if digest(raw, check[32:40], user) == check[:32]:
                self.key = aes_cbc_decrypt(digest(raw, check[40:48], user), bytes(16), sealed[:32], pad=False)
                return who
        return None

    def _object_key(self, obj: int, gen: int) -> bytes:
        if self.v >= 5:
            return self.key
        data = self.key + obj.to_bytes(3, "little") + gen.to_bytes(2, "little") + b"sAlT" * self.aes
        return hashlib.md5(data).digest()[: min(16, len(self.key) + 5)]

    def decrypt(self, data: bytes, obj: int, gen: int) -> bytes:
        key = self._object_key(obj, gen)
        return (aes_cbc_decrypt(key, data[:16], data[16:]) if len(data) >= 32 else b"") if self.aes else rc4(key, data)

    def encrypt(self, data: bytes, obj: int, gen: int, iv: bytes | None = None) -> bytes:
        key, iv = self._object_key(obj, gen), iv or os.urandom(16)
        return iv + aes_cbc_encrypt(key, iv, data) if self.aes else rc4(key, data)


def new_security(method: str, user: str, owner: str, permissions: int, doc_id: bytes) -> tuple[dict, Security]:
    """An encryption dictionary and its handler: ``RC4-40``, ``RC4-128``, ``AES-128`` or ``AES-256`` (revision 6)."""
    v, r, length = {"RC4-40": (1, 2, 5), "RC4-128": (2, 3, 16), "AES-128": (4, 4, 16), "AES-256": (5, 6, 32)}[method]
    d: dict = {"Filter": Name("Standard"), "V": v, "R": r, "P": permissions, "Length": 8 * length, "O": bytes(48), "U": bytes(48)}
    if v >= 4:
        d |= {"StmF": Name("StdCF"), "StrF": Name("StdCF"), "CF": {"StdCF": {"CFM": Name("AESV2" if v == 4 else "AESV3"), "AuthEvent": Name("DocOpen"), "Length": length}}}
    s = Security(d, doc_id)
    if v < 5:
        owned, key = (user.encode("latin-1", "replace") + PAD)[:32], s._owner_key((owner or user).encode("latin-1", "replace"))
        for i in range(20 if r >= 3 else 1):
            owned = rc4(bytes(k ^ i for k in key), owned)
        d["O"] = s.o = owned
        s.key = s._user_key(user.encode("latin-1", "replace"))
        d["U"] = s.u = s._user_check(s.key).ljust(32, b"\0")
        return d, s
    s.key = os.urandom(32)
    for who, password, mine, sealed in (("user", user, "U", "UE"), ("owner", owner or user, "O", "OE")):
        raw, salts, of = password.encode()[:127], os.urandom(16), s.u[:48] if who == "owner" else b""
        d[mine] = _hash6(raw, salts[:8], of) + salts
        d[sealed] = aes_cbc_encrypt(_hash6(raw, salts[8:], of), bytes(16), s.key, pad=False)
        s.u = bytes(d["U"])
    return d, s
