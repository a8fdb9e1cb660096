"""SHA-256 with a state that can be written down, so that one task goes on where another stopped."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools


@functools.cache
def _crypto() -> ctypes.CDLL:
    """The libcrypto that hashlib is linked with, or the system's."""
    names = [ctypes.util.find_library("crypto")]
    try:
        import _hashlib

        names.insert(0, getattr(_hashlib, "__file__", None))
    except ImportError:
        pass
    for name in filter(None, names):
        try:
            lib = ctypes.CDLL(name)
            lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_void_p, ctypes.c_size_t]
            lib.SHA256_Init.argtypes, lib.SHA256_Final.argtypes = [ctypes.c_void_p], [ctypes.c_char_p, ctypes.c_void_p]
            return lib
        except (OSError, AttributeError):
            continue
    raise OSError("files that are hashed in stretches need OpenSSL's libcrypto")


class Sha256:
    """Like hashlib.sha256, and begun from a state where one is given."""

    SIZE = 112  # SHA256_CTX: eight words, the count of bits, a block that is not full, two numbers

    def __init__(self, state: bytes | None = None):
        self._at = ctypes.create_string_buffer(state, self.SIZE) if state else ctypes.create_string_buffer(self.SIZE)
        if not state:
            _crypto().SHA256_Init(self._at)

    def update(self, data: bytes) -> None:
        _crypto().SHA256_Update(self._at, ctypes.c_char_p(data), len(data))

    def state(self) -> bytes:
        return self._at.raw

    def hexdigest(self) -> str:
        out, last = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.state(), self.SIZE)
        _crypto().SHA256_Final(out, last)
        return out.raw.hex()
