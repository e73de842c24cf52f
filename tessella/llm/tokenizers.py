"""What the tokenizer operators share: vocabulary files and a bounded cache.

A vocabulary file is read by the driver from the path given and broadcast; it
is a few megabytes whatever the data. Python workers keep what they build from
it, by its digest.
"""

import hashlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

_BUILT: dict[tuple, object] = {}


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable letter: printable
    Latin-1 bytes as themselves, the others in order from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A broadcast vocabulary file; ``build`` makes an object of it once a worker."""

    def __init__(self, spark: SparkSession, path: str):
        content = Path(path).read_text(encoding="utf-8")
        self.key = hashlib.sha256(content.encode()).hexdigest()
        self._shared = spark.sparkContext.broadcast(content)

    def build(self, make: Callable[[str], object]):
        key = (self.key, make.__qualname__)
        if key not in _BUILT:
            _BUILT[key] = make(self._shared.value)
        return _BUILT[key]


class Memo(dict):
    """``make``'s results for the keys used lately: two generations of ``limit`` keys.

    Text keys over ``longest`` characters, if that is set, are not kept.
    """

    def __init__(self, make: Callable, limit: int = 200_000, longest: int = 0):
        super().__init__()
        self.make, self.limit, self.longest, self.older = make, limit, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if self.longest and len(key) > self.longest:
                return value
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
