"""Encoding whole texts with a tokenizers file, word by word with a cache.

Both tokenizers cut a text before a blank that is followed by a visible character, whatever stands around, so the
parts between such cuts can be encoded one by one and joined. Parts seen before come from a bounded cache kept by
the Python worker; the library encodes the others. Any other white space stays inside its part. A part of Latin
letters alone is one word to the tokenizer's own splitting, so the library's merges are called on it directly. A
word and the symbols after it are looked up one by one where the splitting cuts between them.
"""

from __future__ import annotations

from eligrid.llm.common import worker_cache

# Entries of one worker's cache; beyond it, further words are encoded each time.
CACHE_WORDS = 700_000


class Encoder:
    """ids of a text as little-endian unsigned 32-bit bytes; special-token strings in a text are found as such."""

    def __init__(self, path: str, keeps_blanks: bool):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_blanks = keeps_blanks
        self.cut = re.compile(r" (?=\S)")
        encode, merge = self.tokenizer.encode, self.tokenizer.model.tokenize
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str

        class Shown(dict):
            """Letter -> how the splitting shows it to the merges."""

            def __missing__(self, code):
                self[code] = split("a" + chr(code))[0][0][1:]
                return self[code]

        shown = Shown()
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

        def after_letter(c):
            """Whether the splitting cuts between a letter and any number of these."""
            return all([x for x, _ in split("a" + c * n)] == ["a", c * n] for n in (1, 2, 3))

        # An apostrophe may belong to the letters after it.
        symbols = "".join(filter(after_letter, "!#$%&*+,-./:;=?@^_|~")) if keeps_blanks else ""

        def plain(part):
            # Composed letters up to here are as stable in every Unicode version as ASCII.
            return part.isalpha() and (part.isascii() or max(part) < "\u0250")

        class Cache(dict):
            def __init__(self, lead):
                super().__init__()
                self.lead = lead
                # What the splitting puts before a word; None where it does more than that.
                found = [[x for x, _ in split(lead + probe)] for probe in ("a", "qzx")]
                ends = all(len(x) == 1 and x[0].endswith(probe) for x, probe in zip(found, ("a", "qzx")))
                self.mark = found[0][0][:-1] if ends and found[0][0][:-1] == found[1][0][:-3] else None

            def __missing__(self, part):
                import struct

                if part[-1:] in (".", ",") and part[-2:-1].isalpha() and part[-2].islower():
                    # A letter and a mark after it are never one token.
                    return self[part[:-1]] + marks[part[-1]]
                if part[:1] == "\n" and len(part) > 1 and self is later:
                    return self.keep(part, first["\n"] + first[part[1:]])
                stem = part.rstrip(symbols) if symbols else part
                if stem != part and plain(stem) and not any(x in part for x in added):
                    return self.keep(part, self[stem] + first[part[len(stem) :]])
                low = part.lower() if folds else part
                if low != part and plain(low):
                    return self[low]
                if self.mark is not None and low == part and plain(part):
                    ids = [x.id for x in merge(self.mark + (part if part.isascii() else part.translate(shown)))]
                else:
                    ids = encode(self.lead + part, add_special_tokens=False).ids
                return self.keep(part, struct.pack(f"<{len(ids)}I", *ids))

            def keep(self, part, value):
                if len(self) < CACHE_WORDS and len(part) <= 64:
                    self[part] = value
                return value

        folds = not keeps_blanks  # that tokenizer lower-cases
        first, later = self.first, self.later = Cache(""), Cache(" " if keeps_blanks else "")
        marks = first

    def encode(self, text: str) -> bytes:
        if not self.keeps_blanks:
            # White space only separates words here.
            return b"".join(map(self.later.__getitem__, text.replace("\n", " ").split(" ")))
        lines = text.split("\n")
        if "  " in text or any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
            parts = self.cut.split(text)
            return self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:]))
        # Every line feed stands alone between visible characters and is a token of its own.
        parts = text.replace("\n", " \n").split(" ")
        return self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:]))


def encoder(path: str, keeps_blanks: bool) -> Encoder:
    return worker_cache(("encoder", path), lambda: Encoder(path, keeps_blanks))
