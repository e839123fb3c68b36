"""Token counts by prefix dynamic programming over a word-end BPE vocabulary.

For every prefix of a word the table holds how many tokens the prefix has when the text ends there. A prefix
has exactly one last token that can follow the last token of what stands before it, so the count is one more
than the count there; a pair of tokens can follow each other if encoding both together gives them back. The
counts of a text's prefixes follow by adding up words, so cutting a text to a budget needs no new encoding.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, islice

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import ease, needs, text_of

LIMIT = 2048
#: Words whose counts a worker keeps before it starts afresh, and pairs of tokens.
KEPT_WORDS, KEPT_PAIRS = 1_000_000, 1_000_000

#: Fixed values of the tokenizer's file format: the pattern of its words, and Unicode white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"
ASCII_WORDS = re.compile(WORDS.format(L="a-zA-Z", N="0-9", S=SPACE))
WORD_END = "</w>"
#: Letters and numbers of Unicode 16, as the library has them, beyond those of Unicode 15.1.
LETTERS_16 = (
    r"\u1c89\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4"
    r"\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0"
    r"\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0"
)
NUMBERS_16 = r"\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa"
#: Small letters of the capitals that Unicode 16 and 17 added.
SMALL_17 = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
SMALL_17 |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}

#: Marks that Unicode added after version 9. The library's NFC, which is of that version, neither
#: moves nor composes them.
MARKS_10 = (
    r"\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c\U00010d24-\U00010d27"
    r"\U00010eab\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e"
    r"\U00011839\U0001183a\U00011930\U0001193d\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44"
    r"\U00011d45\U00011d97\U00011f41\U00011f42\U00016ff0\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef"
    r"\U0001e4ec-\U0001e4ef"
)
_MARKS = re.compile(f"([{MARKS_10}])")


@lru_cache(maxsize=1)
def _patterns() -> tuple[regex.Pattern, regex.Pattern, re.Pattern, re.Pattern]:
    """The words of a text by the classes of the regex module, and by the library's; characters that these put
    otherwise, or whose small letters Python's tables don't know yet, and all from the first of those on."""

    def runs(points: list[int]) -> str:
        ends = [i for i, c in enumerate(points) if points[i + 1 : i + 2] != [c + 1]]
        return "".join(f"\\U{points[a]:08x}-\\U{points[b]:08x}" for a, b in zip([0, *(i + 1 for i in ends)], ends))

    def points(ranges: str) -> set[int]:
        return {c for a, b in re.findall(r"([^-])(?:-([^-]))?", regex.sub(r"\\[uU]([0-9a-f]{8}|[0-9a-f]{4})", lambda m: chr(int(m[1], 16)), ranges)) for c in range(ord(a), ord(b or a) + 1)}

    classes = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    apart, own = set(SMALL_17), {}
    for k, more in (("L", LETTERS_16), ("N", NUMBERS_16)):
        mine = {c for c, x in enumerate(classes) if x == k} | points(more)
        own[k] = runs(sorted(mine))
        apart |= {*map(ord, regex.findall(rf"\p{{{k}}}", every))} ^ mine
    plain, exact = WORDS.format(L=r"\p{L}", N=r"\p{N}", S=SPACE), WORDS.format(**own, S=SPACE)
    return regex.compile(plain), regex.compile(exact), re.compile(f"[{runs(sorted(apart))}]"), re.compile(f"[{chr(min(apart))}-{chr(0x10FFFF)}]")


def _apart(text: str) -> bool:
    _, _, apart, beyond = _patterns()
    return not text.isascii() and beyond.search(text) is not None and apart.search(text) is not None


def words_of(text: str) -> re.Pattern | regex.Pattern:
    """The pattern that finds the words of a normalised text as the library does."""
    return ASCII_WORDS if text.isascii() else _patterns()[_apart(text)]


def normalised(text: str) -> str:
    """NFC and small letters, letter by letter, so that a capital sigma is never a final one."""
    if text.isascii():
        return text.lower()
    if _patterns()[3].search(text):
        text = "".join(unicodedata.normalize("NFC", x) for x in _MARKS.split(text))
    else:
        text = unicodedata.normalize("NFC", text)
    if _apart(text):
        text = text.translate(SMALL_17)
    return text.replace("Σ", "σ").lower()


def byte_letters() -> dict[str, int]:
    """Letter -> byte, as byte-level vocabularies write bytes: visible Latin-1 letters stand for themselves,
    the other bytes for the letters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    """Token counts of all prefixes of words, for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()

        def symbols(token: str) -> tuple[bytes, bool]:
            end = token.endswith(WORD_END) and len(token) > len(WORD_END)
            return bytes(letters[c] for c in (token[: -len(WORD_END)] if end else token)), end

        tokens = [symbols(t) for t in data["model"]["vocab"]]
        self.tokens = tokens
        known = {t: i for i, t in enumerate(tokens)}
        self.rank: dict[int, tuple[int, int]] = {}  # of a pair of tokens: its place among the merges, and what it gives
        for i, (a, b) in enumerate(data["model"]["merges"]):
            (x, _), (y, end) = a, b = symbols(a), symbols(b)
            self.rank[known[a] << 20 | known[b]] = i, known[x + y, end]
        self.bytes = [[known.get((bytes([b]), end), -1) for b in range(256)] for end in (False, True)]
        self.number: dict[bytes, tuple[int, int]] = {}  # of a token within a word and at its end, or -1
        for i, (t, end) in enumerate(tokens):
            own = self.number.get(t, (-1, -1))
            self.number[t] = (own[0], i) if end else (i, own[1])
        lengths: dict[bytes, set[int]] = {}
        for t, _ in tokens:
            if len(t) > 2:
                lengths.setdefault(t[-3:], {1, 2}).add(len(t))
        self.lengths = {x: tuple(sorted(n, reverse=True)) for x, n in lengths.items()}  # of tokens, by their last bytes
        special = [t["content"] for t in data["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words: dict[str, bytes | tuple[int, ...]] = {}  # tokens of each of its prefixes
        self.whole: dict[str, int] = {}  # tokens of all of it
        self.pairs: dict[int, bool] = {}

    def merged(self, data: bytes, end: bool) -> list[int]:
        """The numbers of the tokens of some bytes by their merges, least rank first."""
        inner, ended = self.bytes
        parts = [inner[b] for b in data]
        if end:
            parts[-1] = ended[data[-1]]
        rank, none = self.rank.get, (1 << 30, -1)
        ranks = [rank(a << 20 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least is none:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [least[1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] << 20 | parts[at], none)
            if at < len(ranks):
                ranks[at] = rank(parts[at] << 20 | parts[at + 1], none)
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether token b can stand after token a (-1: at the start); kept in pairs."""
        data, end = self.tokens[b]
        want = [b] if a < 0 else [a, b]
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        known = self.pairs[a << 20 | b] = self.merged(data if a < 0 else self.tokens[a][0] + data, end) == want
        return known

    def learn(self, words: set[str]) -> None:
        """Keep the tokens of each word's prefixes of 1, 2, ... characters, each as a word of its own.

        The words are taken in order, so that one begins where it parts from the word before.
        """
        number, pairs, follows, lengths = self.number.get, self.pairs, self.follows, self.lengths.get
        last, count, out, before, data, short = [-1], [0], [], "", b"", (2, 1)
        for word in sorted(words):
            same = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                same += 1
            if word.isascii():
                data, kept, ends = word.encode(), same, None
            else:
                data, kept = word.encode(), len(word[:same].encode())
                ends = {*accumulate(len(c.encode()) for c in word)}
            del last[kept + 1 :], count[kept + 1 :], out[same:]
            for i in range(kept + 1, len(data) + 1):
                inner = ended = None  # the token before the last one of this prefix, within a word and as a word
                if ends is not None and i not in ends:
                    ended = -1
                for n in lengths(data[i - 3 : i], short) if i > 2 else short:
                    j = i - n
                    if j < 0 or (found := number(data[j:i])) is None:
                        continue
                    a = last[j]
                    if inner is None and (b := found[0]) >= 0:
                        ok = pairs.get(a << 20 | b)
                        if ok or ok is None and follows(a, b):
                            inner, token = j, b
                    if ended is None and (b := found[1]) >= 0:
                        ok = pairs.get(a << 20 | b)
                        if ok or ok is None and follows(a, b):
                            ended = j
                    if inner is not None and ended is not None:
                        break
                last.append(token)
                if ended >= 0:
                    out.append(count[ended] + 1)
                count.append(count[inner] + 1)
            before = word
            self.words[word] = bytes(out) if len(out) < 256 else tuple(out)
            self.whole[word] = out[-1]

    def parts(self, text: str) -> Iterator[str | None]:
        """The normalised text between special strings, and None for each of those."""
        pieces = self.special.split(text) if self.special and self.special.search(text) else [text]
        for i, piece in enumerate(pieces):
            if i:
                yield None
            yield normalised(piece)

    def counts(self, words: list[str]) -> list[bytes | tuple[int, ...]]:
        try:
            return [self.words[w] for w in words]
        except KeyError:
            self.meet([words])
            return [self.words[w] for w in words]

    def meet(self, lists: list[list[str]]) -> None:
        """Learn what is new in the lists; a worker that keeps too many words starts afresh."""
        new = set().union(*lists)
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
            self.whole.clear()
        self.learn(new.difference(self.words))

    def totals(self, texts: list[str], budget: int) -> tuple[list[int], list[int]]:
        """Tokens of each text, and characters of its longest prefix that has at most budget tokens.

        Prefixes are of the normalised text, a special string as one character. Each text is normalised and
        cut into words once; new words of several texts are learnt together.
        """
        totals, fits, group, size = [], [], [], 0
        for k, text in enumerate(texts):
            parts = [*self.parts(text)]
            group.append((parts, [[] if p is None else words_of(p).findall(p) for p in parts]))
            size += len(text)
            if size > 4_000_000 or k == len(texts) - 1:
                self.meet([w for _, lists in group for w in lists])
                for parts, lists in group:
                    n, fit = self._counted(parts, lists, budget)
                    totals.append(n)
                    fits.append(fit)
                group, size = [], 0
        return totals, fits

    def _counted(self, parts: list[str | None], lists: list[list[str]], budget: int) -> tuple[int, int]:
        """Tokens of parts of a text with their known words, and characters that fit in the budget."""
        done = length = fit = 0
        for part, words in zip(parts, lists):
            own = [1] if part is None else [*map(self.whole.__getitem__, words)]
            n = sum(own)
            if done + n <= budget:
                length += 1 if part is None else len(part)
                fit = length
            elif done <= budget and part is not None:  # the word in which the budget ends
                at = bisect_right([*accumulate(own)], budget - done)
                before = done + sum(own[:at])
                begin = next(islice(words_of(part).finditer(part), at, None)).start()
                fit = length + begin + max((i for i, x in enumerate(self.words[words[at]], 1) if before + x <= budget), default=0)
            done += n
        return done, fit

    def prefixes(self, text: str) -> list[int]:
        """The exact token count at every prefix, of 1, 2, ... characters, of the normalised text."""
        out, done = [], 0
        for part in self.parts(text):
            if part is None:
                done += 1
                out.append(done)
                continue
            at, words = 0, words_of(part)
            for m, c in zip(words.finditer(part), self.counts(words.findall(part))):
                out += [done] * (m.start() - at) + [done + x for x in c]
                at, done = m.end(), done + c[-1]
            out += [done] * (len(part) - at)
        return out

    def within(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of the normalised text that has at most budget tokens.

        A special string counts as one character.
        """
        return self.totals([text], budget)[1][0]


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """One for each worker process and file."""
    return PrefixCounter(path)


def prefix_counts(text: Column, path: str) -> Column:
    """array<int>: the token count at every prefix of the normalised text; empty for an empty or null text."""

    @F.pandas_udf("array<int>")
    def at_prefixes(texts: pd.Series) -> pd.Series:
        return pd.Series([counter(path).prefixes(t or "") for t in texts], dtype=object)

    return at_prefixes(text)


def token_counts(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) for every row of documents (doc_id, text).

    Counts are those of the tokenizers library for the vocabulary at path, special strings in a text as
    single tokens. fit_chars is how many characters of the normalised text fit in limit tokens. A null text
    counts as empty: no bytes, no tokens, nothing over the limit. Texts of any length are counted whole, in
    memory that grows with one text at a time. Equal rows give equal rows; other columns are not read.
    """

    @F.pandas_udf("n long, fit long")
    def counted(texts: pd.Series) -> pd.DataFrame:
        ease()
        n, fit = counter(path).totals([*texts], limit)
        return pd.DataFrame({"n": pd.Series(n, dtype="int64"), "fit": pd.Series(fit, dtype="int64")})

    rows = needs(documents, "doc_id", "text").select("doc_id", text_of().alias("text"))
    return rows.withColumn("c", counted("text")).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.col("c.n").alias("n_tokens"),
        (F.col("c.n") > limit).alias("over_limit"), F.col("c.fit").alias("fit_chars"),
    )
