"""URL filters: all glob rules run at once over each canonical URL as a bit-parallel (Shift-And) automaton of several words.

A rule is a glob over the canonical URL: `*` stands for any run of characters, `?` for one, anything else for itself. The rules'
characters occupy consecutive bits of 64-bit words; one step shifts all states by a bit (with a carry from word to word), keeps
those that the URL's next byte allows, and lets the states before a `*` stay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Production rules of the method: hosts and paths that are not wanted. They apply where no host/path rule decides.
GLOBS = ("*://*cheap-pills.*", "*://*spam-farm.*", "*://*casino*", "*://*/wp-login*", "*://*/cgi-bin/*", "*://*adult-*", "*://*.onion/*")
#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's; the longest fitting one wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


#: Globs of a rule file at most; the automaton takes a bit for each of their characters in every worker.
MOST_GLOBS = 100_000


def load_globs(spark: SparkSession, path: str) -> list[str]:
    """The globs of a text file, one a line; blank lines and those that begin with # are none. More than MOST_GLOBS are an error."""
    line = F.trim("value")
    found = spark.read.text(path).select(line.alias("g")).where((F.col("g") != "") & ~F.col("g").startswith("#")).limit(MOST_GLOBS + 1).collect()
    if len(found) > MOST_GLOBS:
        raise ValueError(f"{path}: more than {MOST_GLOBS} globs")
    return [r["g"] for r in found]


class Automaton:
    """Glob rules packed into multiword masks."""

    def __init__(self, globs: Sequence[str]):
        bits, stars, first, injected, final = [], [], [], [], []  # bytes allowed; bits that stay; bits that start; those that start anywhere; last bits
        self.always = [i for i, g in enumerate(globs) if g and not g.strip("*")]
        self.empty = [i for i, g in enumerate(globs) if not g]
        self.rule = []
        for i, g in enumerate(globs):
            chars = [x for c in g for x in ([c] if c in "*?" else [bytes([b]) for b in c.encode()])]
            if not any(c != "*" for c in chars):
                continue
            anywhere, fresh = False, True
            for c in chars:
                if c == "*":
                    if fresh:
                        anywhere = True
                    else:
                        stars.append(len(bits) - 1)
                    continue
                if fresh:
                    (injected if anywhere else first).append(len(bits))
                    fresh = False
                bits.append(None if c == "?" else c[0])
            final.append(len(bits) - 1)
            self.rule.append(i)
        self.words = max(1, -(-len(bits) // 64))
        self.allowed = np.zeros((256, self.words), np.uint64)
        for k, b in enumerate(bits):
            # `?` is one character: its first byte; continuation bytes stay with it
            for v in (b,) if b is not None else (x for x in range(256) if not 0x80 <= x < 0xC0):
                self.allowed[v, k // 64] |= np.uint64(1 << (k % 64))
        self.any = self._mask([k for k, b in enumerate(bits) if b is None])
        self.stay, self.first, self.injected = (self._mask(x) for x in (stars, first, injected))
        # a shift must not run from one rule's last bit into the next rule's first
        self.heads = ~(self.first | self.injected)
        self.final = final

    def _mask(self, ks: Sequence[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for k in ks:
            out[k // 64] |= np.uint64(1 << (k % 64))
        return out

    def match(self, data: np.ndarray, at: np.ndarray, n_rules: int) -> np.ndarray:
        """Booleans (texts, rules): which rules match which whole texts, all texts advancing together."""
        n, size = len(at) - 1, np.diff(at)
        out = np.zeros((n, n_rules), bool)
        out[:, self.always] = True
        out[np.ix_(size == 0, self.empty)] = True
        order = np.argsort(-size, kind="stable")
        lengths, begin = size[order], at[:-1][order]
        state = np.zeros((n, self.words), np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        live = n
        for step in range(int(lengths[0]) if n else 0):
            live = int(np.searchsorted(-lengths, -step, side="left"))  # those longer than step
            old, byte = state[:live], data[begin[:live] + step]
            moved = old << one
            moved[:, 1:] |= old[:, :-1] >> top
            moved &= self.heads
            moved |= self.injected
            if step == 0:
                moved |= self.first
            moved &= self.allowed[byte]
            within = (byte >= 0x80) & (byte < 0xC0)  # later bytes of one character: a `?` just taken stays
            moved |= old & np.where(within[:, None], self.stay | self.any, self.stay)
            state[:live] = moved
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        for i, k in zip(self.rule, self.final):
            out[:, i] = ((state[:, k // 64] >> np.uint64(k % 64)) & one).astype(bool)[back] & (size > 0)
        return out


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty without `://`."""
    if url is None or (k := url.find("://")) < 0:
        return "", ""
    rest = url[k + 3 :]
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(_LOWER), tail[:stop]


def canonical(url: str | None) -> str:
    """scheme://host/path?query in one form: scheme and host lower-cased, user, default port, `www.` and fragment dropped."""
    if url is None or (k := url.find("://")) < 0:
        return url or ""
    scheme, (host, path) = url[:k].translate(_LOWER), split_url(url)
    rest = url[k + 3 :].partition("#")[0]
    query = rest.partition("?")[2]
    host = host.rpartition("@")[2].removesuffix({"http": ":80", "https": ":443"}.get(scheme, "\0")).rstrip(".").removeprefix("www.")
    return f"{scheme}://{host}{path or '/'}" + (f"?{query}" if query else "")


def best_rule(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str | None, str | None]:
    """The longest fitting rule and its verdict: host parts are looked up from the whole host down to its last part."""
    best, verdict, parts = None, None, host
    while parts:
        for start, v in rules.get(parts, ()):
            if path.startswith(start) and (best is None or len(parts + start) > len(best)):
                best, verdict = parts + start, v
        parts = parts.partition(".")[2]
    return best, verdict


def filter_urls(pages: DataFrame, globs: Sequence[str] = GLOBS, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, canonical_url, globs (those that match).

    verdict: the longest fitting host/path rule's, else block if a glob matches the canonical URL, else allow. A null url and one without `://` have an
    empty host and path and no rule; globs then see the url as it stands (null: empty). Null page_ids and repeated rows keep their
    rows, an empty table gives none, and other columns are ignored and not read.
    """
    globs, by_host = list(globs), {}
    for verdict, host, path in rules:
        by_host.setdefault(host, []).append((path, verdict))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(globs)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                urls = part.column("url").to_pylist()
                forms = [canonical(u) for u in urls]
                raw = [f.encode() for f in forms]
                hits = machine.match(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), len(globs))
                places = [split_url(u) for u in urls]
                found = [best_rule(h, p, by_host) for h, p in places]
                matched = [[globs[j] for j in np.flatnonzero(row)] for row in hits]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"),
                        pa.array([h for h, _ in places], pa.string()),
                        pa.array([p for _, p in places], pa.string()),
                        pa.array([r for r, _ in found], pa.string()),
                        pa.array([v or ("block" if m else "allow") for (_, v), m in zip(found, matched)], pa.string()),
                        pa.array(forms, pa.string()),
                        pa.array(matched, pa.list_(pa.string())),
                    ],
                    names=["page_id", "host", "path", "rule", "verdict", "canonical_url", "globs"],
                )

    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return urls.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, canonical_url string, globs array<string>")
