"""What a Python worker remembers between batches."""

import sys

# What a dictionary entry takes besides its key and value.
ENTRY = 120


class Memory:
    """Values by key, up to about ``most`` bytes in two generations: what was not asked for while the younger one filled up
    is forgotten. Keys longer than ``longest`` are forgotten with the next call."""

    def __init__(self, most: int, longest: int = 64):
        self.half, self.longest = max(1, most // 2), longest
        self.young, self.old, self.brief, self.bytes = {}, {}, [], 0

    def ready(self, keys: set, learn) -> dict:
        """A dict that holds a value for every key; ``learn`` makes those of a list of unknown keys."""
        for key in self.brief:
            del self.young[key]
        self.brief = []
        missing = keys.difference(self.young)
        if missing:
            again = {k: self.old[k] for k in missing if k in self.old}
            again |= learn([k for k in missing if k not in again])
            self.brief = [k for k in again if len(k) > self.longest]
            added = weight(again)
            if self.bytes + added > self.half:
                self.old, self.young = self.young, {k: self.young[k] for k in keys if k in self.young}
                self.bytes = weight(self.young)
            self.young |= again
            self.bytes += added - weight({k: again[k] for k in self.brief})
        return self.young


def weight(entries: dict) -> int:
    size = sys.getsizeof
    return sum(map(size, entries)) + sum(map(size, entries.values())) + ENTRY * len(entries)
