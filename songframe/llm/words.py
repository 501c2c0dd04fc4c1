"""A bounded memory of what has been computed for a word."""

from __future__ import annotations

#: Keys of more characters are computed each time, so that the memory is bounded in
#: bytes too: a text of long words (encoded binary data, say) leaves nothing behind.
LONGEST = 64


class Recent(dict):
    """Values by key. When `most` are held they become the older half, which is
    dropped when the next half is full; keys asked for again move up. Keys longer than
    LONGEST are not held."""

    def __init__(self, make, most: int = 150_000):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
