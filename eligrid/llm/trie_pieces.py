"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

A text is cut into marked words (runs of blanks as marks, then what follows). The distinct new words of a chunk of
rows are sorted, which lays them out as a trie in depth-first order, and one forward table is kept along the current
path: a word starts from the state of its longest common prefix with the word before it.

The pieces that end at a character come from a walk through all beginnings of pieces, kept along the same path. A
tail of marks is a word of its own where no piece holds the two characters around the cut side by side: no
segmentation and no merge crosses there.

The forward state after a prefix is its best segmentation. For a unigram model that is the one with the largest sum
of scores. For a BPE model it is the one the merges make: a segmentation is the outcome of the merges exactly when
every two neighbouring pieces are the outcome of the merges on their own text, so of the pieces that end at a
position only one fits the state where it starts. Both give what the library gives. Characters outside the
vocabulary become byte pieces.

Decoding turns ids into pieces, byte pieces into bytes, marks into blanks, and drops the leading mark.

Defined results: null and empty texts have no ids and decode to an empty text. A mark character inside a text decodes
to a blank. Ids, rows and their order do not depend on how rows are spread. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from eligrid.llm.common import worker_cache

BLANK = "▁"
# Words and neighbour checks that a worker keeps, rows whose new words are encoded together.
CACHE_WORDS = 150_000
CACHE_PAIRS = 300_000
CACHE_STEPS = 100_000
CHUNK_ROWS = 1024
# Added to ids in the keys of neighbour checks; characters outside the vocabulary count as negative ids.
OUTSIDE = 0x110000


class Pieces:
    """Vocabulary of a model file and the forward pass over words."""

    def __init__(self, path: str, kind: str):
        import re

        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = kind
        size = model.get_piece_size()
        self.piece_bytes, self.ids, self.scores, self.byte_ids = [], {}, [], {}
        for i in range(size):
            piece = model.id_to_piece(i)
            self.scores.append(model.get_score(i))
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.piece_bytes.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.piece_bytes.append(b"")
            else:
                self.ids[piece] = i
                self.piece_bytes.append(piece.replace(BLANK, " ").encode())
        # Walk of a text through all beginnings of pieces: (longest one that ends here, pieces that end here).
        self.beginnings = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        self.walk = {}
        # A word is cut before its tail of marks where no piece holds the two characters around the cut side by side.
        self.tail_marks = "".join(c for c in set().union(*self.ids) if not c.isalnum() and c != BLANK and not c.isspace())
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.unknown = min(self.scores, default=0.0) - 10.0
        self.fits, self.cache = {}, {}
        self.newline_apart = not any("\n" in p for p in self.ids)
        self.cut = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")

    def merged(self, text):
        """Pieces that the merges make of a short text: best-scored neighbours first, leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _step(self, path):
        """Where the walk is after these characters, the last of them new, and (length, id) of the pieces that end there."""
        node = path
        while node and node not in self.beginnings:
            node = node[1:]
        ending = [(len(node) - i, self.ids[node[i:]]) for i in range(len(node)) if node[i:] in self.ids]
        if path[-1] not in self.ids:
            ending.append((1, -ord(path[-1])))
        if len(self.walk) < CACHE_STEPS:
            self.walk[path] = node, tuple(ending)
        return node, ending

    def _fit(self, key, left, right):
        """Whether right may follow left (empty at the start of a word): the merges leave both as they are."""
        if left and left + right in self.ids:
            value = False  # the merges would join them
        else:
            value = self.merged(left + right) == ([left, right] if left else [right])
        if len(self.fits) < CACHE_PAIRS:
            self.fits[key] = value
        return value

    def encode_words(self, words):
        """word -> ids of each distinct word, walking the sorted words as a trie."""
        out, previous = {}, ""
        # States of the current path: score, last piece as id, its start, place of the walk, for the best segmentation
        # of i characters.
        states = [(0.0, len(self.scores), 0, "")]
        walk, fits, scores, bpe = self.walk.get, self.fits.get, self.scores, self.kind == "bpe"
        for word in sorted(words):
            shared, most = 0, min(len(word), len(previous))
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            del states[shared + 1 :]
            node = states[shared][3]
            for end in range(shared + 1, len(word) + 1):
                path = node + word[end - 1]
                node, ending = walk(path) or self._step(path)
                best = None
                for size, known in ending:
                    start = end - size
                    before = states[start]
                    if bpe:
                        key = (before[1] + OUTSIDE << 24) + known + OUTSIDE
                        fit = fits(key)
                        if fit is None:
                            fit = self._fit(key, word[before[2] : start], word[start:end])
                        if fit:
                            best = (0.0, known, start, node)
                            break
                    else:
                        score = before[0] + (scores[known] if known >= 0 else self.unknown)
                        if best is None or score > best[0]:
                            best = (score, known, start, node)
                states.append(best)
            ids, end = [], len(word)
            while end:
                _, known, start, _ = states[end]
                if known >= 0:
                    ids.append(known)
                else:
                    ids.extend(self.byte_ids[b] for b in reversed(chr(-known).encode()))
                end = start
            out[word], previous = ids[::-1], word
        return out

    def words_of(self, text):
        if not text:
            return []
        text = BLANK + text.replace(" ", BLANK)
        if not self.newline_apart:
            return [text]
        if BLANK * 2 in text or "\n" + BLANK in text or BLANK + "\n" in text or text[-1] == BLANK:
            return self.cut.findall(text)
        words = []
        for n, line in enumerate(text.split("\n")):
            if n:
                words.append("\n")
            parts = line.split(BLANK)
            if parts[0]:
                words.append(parts[0])
            words += [BLANK + p for p in parts[1:]]
        return words

    def encode_texts(self, texts):
        """Little-endian 32-bit ids of each text; new words of all texts are encoded together."""
        import struct

        lists = [self.words_of(t) for t in texts]
        look, cuts, parts = self.cache, {}, set()
        new = set().union(*lists) - look.keys() if lists else set()
        for word in new:
            at = len(word.rstrip(self.tail_marks))
            if 0 < at < len(word) and word[at - 1 : at + 1] not in self.beside:
                cuts[word] = word[:at], word[at:]
                parts.update(cuts[word])
            else:
                parts.add(word)
        fresh = {w: struct.pack(f"<{len(ids)}I", *ids) for w, ids in self.encode_words(parts - look.keys()).items()}
        before = len(look)
        look.update(fresh)
        look.update({word: look[stem] + look[tail] for word, (stem, tail) in cuts.items()})
        out = [b"".join(map(look.__getitem__, words)) for words in lists]
        # What was added beyond the bound goes again, the newest first.
        for _ in range(len(look) - max(before, CACHE_WORDS)):
            look.popitem()
        return out

    def decode(self, ids):
        text = b"".join(map(self.piece_bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def pieces(path, kind):
    return worker_cache(("pieces", path, kind), lambda: Pieces(path, kind))


def encode(docs: DataFrame, model: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids (little-endian unsigned 32-bit) and text_sha256 of the source text."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        known = pieces(model, kind)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = known.encode_texts(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
                    ],
                    ["doc_id", "n_pieces", "ids", "text_sha256"],
                )

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_pieces long, ids binary, text_sha256 string")


def decode(encoded: DataFrame, model: str, kind: str = "bpe") -> DataFrame:
    """The encoded rows with the text their ids stand for."""
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    place = encoded.columns.index("ids")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = pieces(model, kind)
        for batch in batches:
            texts = [known.decode(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
