"""What a task keeps of the distinct words that it has met."""

from __future__ import annotations

from itertools import islice


class Rows(dict):
    """A row for each distinct word, in the order in which they come; `new` has those that came since it was emptied.

    Beyond `most` words, trim() keeps the first half, among which the frequent words
    are: rows below half of `most` stay what they are.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most, self.new = most, []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        row = self[word] = len(self)
        return row

    def trim(self) -> None:
        if len(self) > self.most:
            first = list(islice(self.items(), self.most // 2))
            self.clear()
            self.update(first)
