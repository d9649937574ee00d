"""Token ids of whole texts by the ``tokenizers`` library, with a cache of encoded words.

The library encodes about one megabyte a second and core. Most words of a corpus repeat, so a
text is cut at blanks where no token can cross, the library encodes a cut when a worker meets it first
(long ones each time), and a text's ids are the joined ids of its cuts. The cuts are chosen so that the result
equals the library's ids for the whole text:

* ``byte level``: no token holds a blank after a non-blank, and the look-ahead in the pattern only
  matters inside runs of white space. A single blank between two printable characters is a cut;
  the blank belongs to the right part. Everything else stays inside a part.
* ``dropped blanks``: the pattern drops white space, so each blank and line feed is a cut.
"""

from __future__ import annotations

import os
from array import array
from pathlib import Path

from lectern.llm.workers import Remembered, own

#: Short words a worker remembers; beyond, it forgets all and starts again.
CACHE_WORDS = 400_000
#: Tokenizer definitions are a few megabytes; a larger file is refused rather than sent to executors.
MAX_DEFINITION_BYTES = 64 << 20


def read_definition(path: str) -> str:
    """A tokenizer's JSON, read on the driver so that executors need no copy of the file."""
    size = Path(path).stat().st_size
    if size > MAX_DEFINITION_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {MAX_DEFINITION_BYTES} are sent to executors")
    return Path(path).read_text(encoding="utf-8")


def load(definition: str):
    """The library's tokenizer; strings of special tokens in a text count as ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(definition)
    t.encode_special_tokens = True
    return t


_MARKS = frozenset(".,;:!?")


def _byte_characters() -> dict[int, int]:
    """The character that byte-level models use for each byte: itself if printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in plain]
    return {x: x for x in plain} | {x: 256 + n for n, x in enumerate(others)}


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids through a bounded cache of parts.

    A part that is one word of Latin letters, perhaps with one mark after it, goes straight to the
    library's model, without its pre-tokenizer; probes at the start tell whether that gives the same ids.
    """

    def __init__(self, definition: str, cache_words: int = CACHE_WORDS):
        self.tokenizer = load(definition)
        self.model = self.tokenizer.model
        self.drops_blanks = not self._keeps_blanks()
        self.lead = "" if self.drops_blanks else " "
        self.table = _byte_characters()
        normalizer = self.tokenizer.normalizer
        self.normalize = normalizer.normalize_str if normalizer else str
        self.parts = Remembered(self._part, cache_words)
        self.first, self.lowers = chr(self.table[0x20]) if self.lead else "", self.normalize("A") == "a"
        self.marks = {x: self._library([x])[0] for x in _MARKS}
        probes = ["a", "Word", "ABC", "hello", "naïve", "ÜBER", "straße", "aaaaaaaaaaaaaaaaaaaaaaaa", "ª", "Qxz"]
        self.direct = [self._word(self.lead + x) + self.marks[m] for x in probes for m in _MARKS] == self._library([f"{self.lead}{x}{m}" for x in probes for m in _MARKS])

    def _keeps_blanks(self) -> bool:
        whole = self.tokenizer.encode("a a", add_special_tokens=False).ids
        single = self.tokenizer.encode("a", add_special_tokens=False).ids
        return whole != single + single

    def _library(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for i in range(0, len(parts), 8192) for e in self.tokenizer.encode_batch_fast(parts[i : i + 8192], add_special_tokens=False)]

    def _word(self, part: str) -> bytes:
        """Ids of one word of letters, with the blank before it."""
        mapped = self.normalize(part).encode().decode("latin-1").translate(self.table)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def cut(self, text: str) -> tuple[str, list[str]]:
        """The first part, and the others without the blank before them."""
        if self.drops_blanks:
            return "", text.replace("\n", " ").split(" ")  # empty parts have no ids
        words = text.split(" ")
        if text.replace("\n", "").isprintable() and not ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "):
            return words[0], words[1:]
        out = [words[0]]
        for x in words[1:]:
            left = out[-1]
            if x and x[0].isprintable() and left and left[-1] != " " and left[-1].isprintable():
                out.append(x)
            else:
                out[-1] = f"{left} {x}"
        return out[0], out[1:]

    def _part(self, part: str) -> bytes:
        """Ids of a part that follows a blank."""
        if not part:
            return b""
        mark = self.marks.get(part[-1])
        word = part if mark is None else part[:-1]
        if not (self.direct and word.isalpha() and (word.isascii() or max(word) <= "\u00ff")):
            return self._library([self.lead + part])[0]
        if mark is not None:
            return self.parts[word] + mark
        if not word.isascii():
            return self._word(self.lead + word)
        # letters stand for themselves in the byte alphabet
        return array("I", [t.id for t in self.model.tokenize(self.first + (word.lower() if self.lowers else word))]).tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes an id."""
        cuts, get = [self.cut(x) for x in texts], self.parts.__getitem__
        heads = [b""] * len(cuts) if self.drops_blanks else self._library([x for x, _ in cuts])
        return [head + b"".join(map(get, rest)) for head, (_, rest) in zip(heads, cuts, strict=True)]


_encoders: dict[int, WordEncoder] = {}


def worker_encoder(definition: str) -> WordEncoder:
    """One encoder per worker process and definition; a reused worker keeps its cache."""
    own("tokens", _encoders.clear)
    key = hash(definition)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(definition)
    return _encoders[key]
