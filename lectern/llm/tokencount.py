"""Token counts by a compiled finite-state transducer.

Byte-pair encoding is compiled into a deterministic transducer whose transitions carry the number of tokens
that they add. A canonical encoding is known by its neighbours: a token sequence is the encoding of its text
if and only if each two neighbours are the encoding of theirs. So the last token of the encoding of a word's
beginning is the one token that ends there and fits the last token before it, and a state need hold only: for
every end part of what was read that begins some token, that part, the last token before it, and how many
tokens that is behind the present count. There are finitely many states; they and their transitions are made
when first met (``CountingTransducer``), and a worker keeps them up to a bound.

Texts are counted in chunks. White space resets the lexer and the transducer, so the state map of a chunk is
constant after its first white space: it is kept as ``(head, count, tail)``, the part before the first white
space, the tokens between, and the part after the last. Two maps compose by counting ``tail + head`` in the
middle; this is associative, and ``scan`` composes neighbours in a tree. A text of any length is thus counted
in bounded pieces, exactly.

Defined results: a null or empty text has 0 bytes and 0 tokens; the strings of special tokens inside a text
count as one token each, which is the tokenizer's default; repeated rows are counted one by one; an empty
table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
CHUNK = 1 << 16
KEPT_WORDS = 200_000
KEPT_TRANSITIONS = 1_000_000
FINAL = 256  # the last byte of a word is the symbol FINAL + byte

#: The white space of the tokenizer's pattern.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _byte_names() -> dict[str, int]:
    """The printable stand-in of every byte in vocabularies of byte-level encodings."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    for extra, b in enumerate(b for b in range(256) if b not in set(plain)):
        names[chr(256 + extra)] = b
    return names


class CountingTransducer:
    """Counts the tokens of words given as bytes; ``merges`` are pairs of symbol strings by rank."""

    def __init__(self, merges: list[tuple[str, str]]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        # a trie of all tokens; nodes are numbers, children are keyed by (node, symbol)
        self.child: dict[tuple[int, int], int] = {}
        self.token_at: dict[int, str] = {}
        nodes = 1
        for token in [*map(chr, range(2 * FINAL)), *(a + b for a, b in merges)]:
            node = 0
            for symbol in map(ord, token):
                after = self.child.get((node, symbol))
                if after is None:
                    after = self.child[node, symbol] = nodes
                    nodes += 1
                node = after
            self.token_at[node] = token
        self.fits_memo: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        #: a state: (trie node, node of the last token before it or 0, tokens relative to the present count)
        self.states: list[tuple[tuple[int, int, int], ...]] = [((0, 0, 0),)]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def encode(self, word: str) -> list[str]:
        """Plain byte-pair encoding of a string of symbols."""
        parts = list(word)
        rank = self.rank
        while len(parts) > 1:
            best, at = min((rank.get((parts[i], parts[i + 1]), len(rank)), i) for i in range(len(parts) - 1))
            if best == len(rank):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: int, token: int) -> bool:
        if not before:
            return True
        key = (before, token)
        found = self.fits_memo.get(key)
        if found is None:
            if len(self.fits_memo) >= KEPT_TRANSITIONS:
                self.fits_memo.clear()
            pair = [self.token_at[before], self.token_at[token]]
            found = self.fits_memo[key] = self.encode("".join(pair)) == pair
        return found

    def _compile(self, state: int, symbol: int) -> tuple[int, int]:
        """Make the transition of a state over a symbol."""
        grown, last, added = [], 0, 0
        for node, before, behind in self.states[state]:
            after = self.child.get((node, symbol))
            if after is None:
                continue
            grown.append((after, before, behind))
            if not last and after in self.token_at and self.fits(before, after):
                last, added = after, behind + 1
        reached = tuple((node, before, behind - added) for node, before, behind in grown if symbol < FINAL) + ((0, last, 0),)
        number = self.number.get(reached)
        if number is None:
            number = self.number[reached] = len(self.states)
            self.states.append(reached)
        move = self.moves[state << 9 | symbol] = (number, added)
        return move

    def count(self, word: bytes) -> int:
        if len(self.moves) >= KEPT_TRANSITIONS:
            self.reset()
        state, total, moves = 0, 0, self.moves
        for symbol in word[:-1]:
            move = moves.get(state << 9 | symbol) or self._compile(state, symbol)
            state = move[0]
            total += move[1]
        symbol = FINAL + word[-1]
        return total + (moves.get(state << 9 | symbol) or self._compile(state, symbol))[1]


class TokenCounter:
    """Counts of a tokenizer file with NFC, lower case, white space dropped and word-end symbols."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = _byte_names()
        end = spec["model"]["end_of_word_suffix"]

        def symbols(token: str) -> str:
            ends = token.endswith(end) and token != end
            values = [names[c] for c in (token[: -len(end)] if ends else token)]
            return "".join(map(chr, values[:-1])) + chr(values[-1] + (FINAL if ends else 0))

        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.transducer = CountingTransducer([(symbols(a), symbols(b)) for a, b in merges])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        self.marker = min((t["content"][:2] for t in spec["added_tokens"]), default="\0")
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        # the same for texts of Latin letters without superscript digits and fractions
        self.latin = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
        self.odd = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]")
        self.memo: dict[str, int] = {}
        self.gap = re.compile(f"[{SPACE}]")

    def plain(self, text: str) -> int:
        """Tokens of a text that begins and ends at white space or an end of the text."""
        if not text:
            return 0
        if self.marker in text:
            parts = self.special.split(text)
            if len(parts) > 1:
                return len(parts) - 1 + sum(map(self.plain, parts))
        if text.isascii() or max(text) < "\u0250":
            text = text.lower()
            words = self.words.findall(text) if self.odd.search(text) else self.latin.findall(text)
        else:
            words = self.words.findall(unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower())
        memo, total = self.memo, 0
        for word in words:
            n = memo.get(word)
            if n is None:
                n = self.transducer.count(word.encode())
                if len(word) <= 64:
                    if len(memo) >= KEPT_WORDS:
                        memo.clear()
                    memo[word] = n
            total += n
        return total

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(head, count, tail); count is None where no white space resets the state."""
        first = self.gap.search(chunk)
        if first is None:
            return chunk, None, ""
        last = max(chunk.rfind(c) for c in set(self.gap.findall(chunk)))
        return chunk[: first.start()], self.plain(chunk[first.start() : last + 1]), chunk[last + 1 :]

    def compose(self, a: tuple, b: tuple) -> tuple[str, int | None, str]:
        if a[1] is None and b[1] is None:
            return a[0] + b[0], None, ""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.plain(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list[tuple]) -> tuple[str, int | None, str]:
        """The composition of all maps, neighbours first."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if len(text) <= chunk:
            return self.plain(text)
        head, n, tail = self.scan([self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)])
        return self.plain(head) + (n or 0) + self.plain(tail)


def _count(path: str, limit: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path)
        for batch in batches:
            counts = [counter.count(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], schema=schema)

    return run


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long"), n_bytes.alias("n_bytes"), F.col("text").cast("string")).mapInArrow(
        _count(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
