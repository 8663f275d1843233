"""Splitting texts into pieces that a BPE tokenizer treats independently, and a bounded cache of what they give.

A split point is used only where it can't change the ids:

* between a non-space character and ASCII white space: no pre-token spans it. Where white space counts, one of ``WIDE`` is no
  non-space character: a pre-token of white space may hold both kinds;
* inside a run of non-space characters, between a letter and an ASCII mark, where the run holds only
  ASCII marks and digits and precomposed Latin letters, no apostrophe (contractions) and no ``<|``
  (special tokens). Runs with any other character stay whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable

#: ASCII letters and the precomposed letters up to U+024F, but for U+0130, whose lower case is two characters.
LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
SPACES = r" \t-\r"
PLAIN_TEXT = re.compile(rf"[{SPACES}!-&(-~{LATIN}]*")
#: White space beyond ASCII, for any library, and what some take for it.
WIDE = r"\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
RUNS = re.compile(rf"[^{SPACES}]+")
PARTS = re.compile(rf"[{LATIN}]+|[^{SPACES}{LATIN}]+")
SPACED_RUNS = re.compile(rf"(?:[{SPACES}]*[^{SPACES}]*[{WIDE}](?=[{SPACES}]))++[{SPACES}]*[^{SPACES}]*|[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
SPACED_PARTS = re.compile(rf"[{SPACES}]*[{LATIN}]+|[{SPACES}]*[^{SPACES}{LATIN}]+|[{SPACES}]+")
#: Parts that a task keeps in each of two generations; what isn't met again in the time of one is forgotten.
CACHE = 250_000


def tokenizer(path: str):
    """The library's tokenizer, one thread a task, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def is_plain(text: str) -> bool:
    return "<|" not in text and PLAIN_TEXT.fullmatch(text) is not None


class PieceCache:
    """Splits texts into independent parts and keeps what ``encode`` gives for each of them.

    ``lower``: the tokenizer lower-cases, so that plain texts may be lower-cased first. ``spaced``: white space counts, and a
    part carries what stands before it; otherwise it is dropped. ``encode`` gets a list of distinct parts."""

    def __init__(self, encode: Callable[[list[str]], list], lower: bool, spaced: bool, limit: int = CACHE):
        self.encode, self.lower, self.limit = encode, lower, limit
        self.runs, self.parts = (SPACED_RUNS, SPACED_PARTS) if spaced else (RUNS, PARTS)
        self.values: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def forget(self) -> None:
        self.values, self.old = {}, {}

    def split(self, text: str) -> list[str]:
        if is_plain(text):
            return self.parts.findall(text.lower() if self.lower else text)
        return [part for run in self.runs.findall(text) for part in (self.parts.findall(run.lower() if self.lower else run) if is_plain(run) else (run,))]

    def learn(self, found: Iterable[str]) -> dict[str, object]:
        """A table that holds every one of ``found`` until the next call."""
        if len(self.values) > self.limit:
            self.old, self.values = self.values, {}
        new = set(found).difference(self.values)
        if again := new.intersection(self.old):
            self.values.update((part, self.old[part]) for part in again)
            new -= again
        if new:
            unknown = list(new)
            self.values.update(zip(unknown, self.encode(unknown), strict=True))
        return self.values
