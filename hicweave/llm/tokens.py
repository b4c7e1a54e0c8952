"""Token ids of whole texts from a byte-level vocabulary file of the tokenizers library."""

from __future__ import annotations

import json
import re
from array import array

#: Signs of a text beyond which its ids are not held as a list of numbers.
LONG = 1 << 18


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in plain]
    return out | {chr(256 + k): b for k, b in enumerate(rest)}


def ranks_of(path: str) -> dict[bytes, int]:
    """Bytes of each token and its id; in such a file ids follow the order of merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_letters()
    first = len(model["vocab"]) - len(model["merges"])
    return {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if i < first + len(model["merges"]) and all(c in letters for c in t)}


class Ids:
    """Texts to ids, 16 bits each. A text is encoded whole: most runs of signs that a memory of runs would spare are short,
    and to find and look them up one by one takes longer than to encode them.

    The names of the file's special tokens become their ids wherever they stand in a text, as the library has it; with
    special=False they are text like any other, so that their ids never occur.
    """

    def __init__(self, path: str, special: bool = True) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            names = {t["content"]: t["id"] for t in json.load(f)["added_tokens"] if t["special"]}
        ranks = {b: i for b, i in ranks_of(path).items() if i not in names.values()}
        if max([*ranks.values(), *names.values()]) >= 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self._encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._special = {n: i.to_bytes(2, "little") for n, i in names.items()} if special else {}
        self._parts = re.compile("(" + "|".join(map(re.escape, self._special)) + ")") if self._special else None

    def __call__(self, text: str) -> bytes:
        if self._parts is not None and any(n in text for n in self._special):
            return b"".join([self._special.get(x) or self._plain(x) for x in self._parts.split(text) if x])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if len(text) > LONG:
            return self._encoding.encode_to_numpy(text, disallowed_special=()).astype("<u2").tobytes()
        return array("H", self._encoding.encode_ordinary(text)).tobytes()
