"""Secret scans: rules find candidates, a random forest takes out what is none.

The forest sees a candidate's length, its character transitions and the part of it that dictionary words cover, signs of paths and
code, and the words around it.  Dictionary and transitions are counted from all documents of the table that is scanned, so
long words of its languages don't look like keys.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, docs_of, map_rows

#: Parts of names that secrets go by; words beside what only looks like one; words of samples and placeholders.
NAMES = ("token", "secret", "password", "passwd", "passphrase", "pwd", "key", "auth", "bearer", "credential", "private", "signature")
OTHERS = ("commit", "sha", "sha256", "md5", "checksum", "hash", "digest", "uuid", "guid", "id", "isbn", "order", "invoice", "phone", "card", "account", "version", "revision", "build", "etag", "integrity", "public", "image", "serial", "tracking")
SAMPLES = ("example", "sample", "dummy", "fake", "test", "your", "changeme", "placeholder", "xxx", "todo", "insert", "redacted", "none", "null", "default", "here")

#: A name with a sign after it: the value follows.  A run of at least 16 characters that encodings of random bytes use.  Both whole,
#: however long; each run of a text is looked at once.
ASSIGNED = re.compile(r"(?<![\w-])([\w-]++)[\"']?+[ \t]*+[=:][ \t]*+[\"']?+(?=[^\s\"'])")
LONG = re.compile(r"(?<![A-Za-z0-9_+/=.@-])[A-Za-z0-9_+/=.@-]{16,}+")
STOP = re.compile(r"[\s\"']|$")
PEM, PEM_BODY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), re.compile(r"[A-Za-z0-9+/=\s]*")
NAMED = re.compile("|".join(NAMES), re.I)
WORDS = re.compile(r"[^\W_]+")
#: Characters before and after a candidate that its features see.
CONTEXT = 48


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(begin, end, rule) in order: key blocks (pem), values with a name that speaks of a secret (named), other runs (long).

    A run that overlaps one of the former counts once, as that.
    """
    found, close = [], None
    for m in PEM.finditer(text):
        if found and m.start() < found[-1][1]:
            continue
        close = text.find("-----END", m.end()) if close is None or -1 < close < m.end() else close
        end = close if close >= 0 else PEM_BODY.match(text, m.end()).end()
        stop = text.find("-----", end + 8) if close >= 0 else -1
        found.append((m.start(), stop + 5 if stop >= 0 else end, "pem"))
    pems, last, taken = [f[0] for f in found], 0, 0
    for m in ASSIGNED.finditer(text):
        if m.end() >= last:  # signs inside one value share its end
            last = STOP.search(text, m.end()).start()
        if m.end() >= taken and NAMED.search(m[1]):  # names inside a value that has a name are part of it
            value = text[m.end() : last].rstrip(",;")
            value = value.rstrip(")]}") if not set(value) & set("([{") else value
            k = bisect_right(pems, m.end()) - 1
            if len(value) >= 8 and not (k >= 0 and m.end() < found[k][1]):
                taken = m.end() + len(value)
                found.append((m.end(), taken, "named"))
    found.sort()
    at, end = 0, 0
    for m in LONG.finditer(text):
        a, b = m.start(), m.start() + len(m[0].rstrip(".=@-"))
        while at < len(found) and found[at][0] < b:
            end = max(end, found[at][1])
            at += 1
        if b - a >= 16 and end <= a:
            found.append((a, b, "long"))
            # what was added lies before all that is still to come, and behind ``at``
    yield from sorted(found)


# -- what the corpus teaches ------------------------------------------------------------------

#: Words of the dictionary, at most: the most frequent ones of all documents; their lengths.
DICTIONARY, SHORTEST, LONGEST = 20_000, 3, 24
LETTERS = "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Lexicon:
    """Frequent words, and the bits that each transition between letters takes in them (27: a letter that is not a-z)."""

    words: frozenset[str]
    bits: np.ndarray

    @staticmethod
    def of(counts: list[tuple[str, int]]) -> Lexicon:
        n = np.ones((27, 27))
        for w, c in counts:
            k = codes(w)
            np.add.at(n, (k[:-1], k[1:]), math.log2(c + 1))
        return Lexicon(frozenset(w for w, _ in counts), -np.log2(n / n.sum(axis=1, keepdims=True)))


def codes(word: str) -> np.ndarray:
    raw = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64) - 97
    return np.where((raw >= 0) & (raw < 26), raw, 26)


def lexicon(df: DataFrame, text_col: str = "text", most: int = DICTIONARY) -> Lexicon:
    """The most frequent words of the whole texts of all rows, ``most`` at most; of words of like frequency all or none.

    A histogram of the words' counts, in steps of an eighth of a power of two, says from which count on they fit; so only the
    words themselves come to the driver, and no task sends a list of its own.
    """
    word = F.explode(F.split(F.lower(F.col(f"`{text_col}`")), r"[^\p{L}]+")).alias("w")
    counts = df.select(word).where(F.length("w").between(SHORTEST, LONGEST)).groupBy("w").count().withColumn("step", F.floor(F.log2("count") * 8).cast("int"))
    table = Stage(counts, "words")
    total, least = 0, 1 << 30
    for step, n in sorted(((r.step, r["count"]) for r in table.df().groupBy("step").count().collect()), reverse=True):
        total += n
        if total > most:
            break
        least = step
    found = sorted((r.w, r["count"]) for r in table.df().where(F.col("step") >= least).select("w", "count").collect())
    table.drop()
    return Lexicon.of(found)


def coverage(text: str, words: frozenset[str]) -> float:
    """The part of a text's characters that dictionary words cover, from the left, the longest first."""
    low, at, n = text.lower(), 0, 0
    while at < len(low):
        for k in range(min(LONGEST, len(low) - at), SHORTEST - 1, -1):
            if low[at : at + k] in words:
                n, at = n + k, at + k
                break
        else:
            at += 1
    return n / max(len(text), 1)


FEATURES = ("length", "entropy", "transition_bits", "class_changes", "digits", "upper", "lower", "other", "hex", "runs", "distinct", "dictionary", "slashes", "word_segments", "path_start", "extension", "dots", "dashes", "at", "code_signs", "assigned", "quoted", "called", "named", "other_named", "sample")


def features(value: str, before: str, after: str, lex: Lexicon) -> list[float]:
    """Length, character transitions, dictionary coverage, path and neighbouring words of one candidate."""
    n = max(len(value), 1)
    counts = {c: value.count(c) for c in set(value)}
    raw = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    lower, upper, digit = (raw >= 97) & (raw <= 122), (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57)
    kind = np.select([lower, upper, digit], [0, 1, 2], 3)
    low = np.where(upper, raw + 32, raw).astype(np.int64) - 97
    low = np.where((low >= 0) & (low < 26), low, 26)
    pair = (kind[:-1] < 2) & (kind[1:] < 2)
    bits = lex.bits[low[:-1], low[1:]][pair].mean() if pair.any() else 8.0
    hexa = digit | (raw >= 97) & (raw <= 102) | (raw >= 65) & (raw <= 70)
    segments = [x for x in re.split(r"[/\\.:_-]+", value) if x]
    near = [w.lower() for w in WORDS.findall(before)[-4:]] + [w.lower() for w in WORDS.findall(after)[:2]]
    name = before.rstrip(" \t\"'=:")
    sign = before.rstrip(" \t\"'")[-1:]
    own = value.lower()
    return [
        math.log2(n), -sum(v / n * math.log2(v / n) for v in counts.values()), float(bits), float((kind[1:] != kind[:-1]).mean()) if n > 1 else 0.0, float(digit.mean()), float(upper.mean()), float(lower.mean()), float((kind == 3).mean()),
        float(hexa.mean()), float((raw[1:] == raw[:-1]).mean()) if n > 1 else 0.0, len(counts) / n, coverage(value, lex.words), value.count("/"),
        sum(s.lower() in lex.words for s in segments) / max(len(segments), 1), float(value.startswith(("/", "./", "../", "~", "$", "%")) or "://" in value), float(bool(re.search(r"\.[a-z]{2,5}$", value))),
        value.count("."), value.count("-"), value.count("@"), float(sum(value.count(c) for c in "()[]{}<>$*%")), float(sign in ("=", ":")), float(before[-1:] in ("\"", "'")), float(after[:1] in ("(", "[") or value.endswith("(")),
        float(bool(NAMED.search(name[-24:]))) + float(any(NAMED.fullmatch(w) for w in near)), float(any(w in OTHERS for w in near)), float(any(w in own for w in SAMPLES) or any(w in SAMPLES for w in near[-4:])),
    ]


# -- the forest -----------------------------------------------------------------------------


@dataclass
class Forest:
    """Trees as arrays: feature (-1: a leaf), threshold, left child (right is the next), part of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, threshold, left, value in self.trees:
            at = np.zeros(len(x), int)
            while (open_ := feature[at] >= 0).any():
                go = left[at] + (x[np.arange(len(x)), np.maximum(feature[at], 0)] > threshold[at])
                at = np.where(open_, go, at)
            out += value[at]
        return out / max(len(self.trees), 1)


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> tuple[np.ndarray, ...]:
    feature, threshold, left, value = [], [], [], []

    def node() -> int:
        for a in (feature, threshold, left, value):
            a.append(0)
        return len(feature) - 1

    todo = [(node(), np.arange(len(x)), 0)]
    while todo:
        at, rows, level = todo.pop()
        p = float(y[rows].mean())
        value[at], feature[at] = p, -1
        if level >= depth or len(rows) < 2 * least or p in (0.0, 1.0):
            continue
        best = (p * (1 - p) * len(rows) - 1e-9, -1, 0.0)
        for f in rng.permutation(x.shape[1])[: max(1, int(np.sqrt(x.shape[1])) + 1)]:
            order = np.argsort(x[rows, f], kind="stable")
            v, t = x[rows, f][order], y[rows][order]
            n, c = np.arange(1, len(v)), np.cumsum(t)[:-1]
            m, d = len(v) - n, t.sum() - c
            cost = c * (1 - c / n) + d * (1 - d / m)
            cost[(v[1:] == v[:-1]) | (n < least) | (m < least)] = np.inf
            k = int(cost.argmin())
            if cost[k] < best[0]:
                middle = float(v[k] + v[k + 1]) / 2
                best = (float(cost[k]), int(f), middle if middle < v[k + 1] else float(v[k]))
        if best[1] >= 0:
            feature[at], threshold[at] = best[1:]
            left[at] = node()
            node()
            low = x[rows, best[1]] <= best[2]
            todo += [(left[at], rows[low], level + 1), (left[at] + 1, rows[~low], level + 1)]
    return np.array(feature), np.array(threshold), np.array(left), np.array(value)


def train(findings: list[tuple[str, str, str, bool]], lex: Lexicon, trees: int = 40, depth: int = 12, least: int = 2, seed: int = 3) -> Forest:
    """From labelled findings (value, text before, text after, is a secret). Without both kinds the forest is empty."""
    y = np.array([f[3] for f in findings], float)
    if not len(y) or y.min() == y.max():
        return Forest()
    x, rng = np.array([features(*f[:3], lex) for f in findings]), np.random.default_rng(seed)
    out = Forest()
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.trees.append(grow(x[rows], y[rows], rng, depth, least))
    return out


# -- labelled findings ------------------------------------------------------------------------
# Written after public formats of keys and after code and settings of all kinds, not after any corpus. {v} is the finding; a name in
# braces is filled by the rule of that name below.

SECRET_LINES = (
    '{NAME} = "{v}"', "{NAME}='{v}'", "{NAME}={v}", "{name}: {v}", '"{name}": "{v}",', "export {NAME}={v}", "--{name}={v} --verbose", "set {name} {v}", "{name} := {v}", "const {name} = '{v}';",
    "Authorization: Bearer {v}", "curl -H 'X-Api-Key: {v}' https://api.service.io", "machine git.host.org login bot password {v}", "the {name} is {v} and", "-u admin:{v} ", "<add key='{name}' value='{v}'/>", "# {v}", "sent {v} by mail",
)
SECRET_KINDS = ("hex32", "hex40", "hex64", "b64", "alnum", "upper", "prefixed", "password", "jwt", "letters")
PLAIN_LINES = (
    ("word_run", "{w} {w} {v} {w}"), ("word_run", "{w}. {V} {w}"), ("word_run", "{name}: {v}"), ("word_run", "the {name} = {v}"), ("snake", "{w} = {v}({w})"), ("snake", '{name} = "{v}"'), ("snake", "{name}={v}"), ("snake", "import {v}"),
    ("digits", "{w} {v} {w}"), ("digits", "order {v} shipped"), ("digits", "{name}: {v}"), ("mail", "write to {v} or"), ("mail", "{w} <{v}>"), ("url", "see {v} for"), ("url", '{name}_url = "{v}"'), ("path", "open {v} first"), ("path", '{name}_file: "{v}"'), ("path", "{name}_path={v}"),
    ("hex40", "commit {v}"), ("hex40", "at revision {v} of"), ("hex32", "md5: {v}"), ("hex64", "sha256 = {v}"), ("hex64", "sha256:{v} "), ("b64", 'integrity="sha512-{v}"'), ("uuid", "id {v} {w}"), ("uuid", '"uuid": "{v}"'), ("hex32", "etag: {v}"), ("b64", "image/png;base64,{v}"), ("hex40", "checksum {v} ok"),
    ("call", "{name} = {v}"), ("call", "{NAME}={v}"), ("sample", '{name} = "{v}"'), ("sample", "{NAME}={v}"), ("stars", "{name}: {v}"), ("variable", "{name}={v}"), ("variable", '"{name}": "{v}"'), ("camel", "{name}: {v},"), ("camel", "new {v} {w}"), ("version", "{w} {v} {w}"), ("plain_key", "key: {v}"), ("plain_key", 'key="{v}"'),
    ("rule", "{v} {w}"), ("date", "at {v} {w}"), ("caps", "{w} {v} {w}"), ("caps", "{v}! {w}"),
)
HEX, ALNUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Public prefixes of keys of well-known services.
PREFIXES = ("ghp_", "gho_", "sk_live_", "rk_live_", "xoxb-", "AKIA", "AIza", "glpat-", "npm_", "SG.", "pk_prod_")


def labelled_findings(lex: Lexicon, n: int = 1500, seed: int = 17) -> list[tuple[str, str, str, bool]]:
    """n secrets and n findings that are none, from the lines above; ordinary words are drawn from the dictionary."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    size = lambda a, b: int(rng.integers(a, b + 1))
    vocabulary = sorted(lex.words) or ["lorem", "ipsum", "dolor", "amet", "value", "server"]
    ascii_ = [w for w in vocabulary if w.isascii()] or vocabulary
    word = lambda: pick(vocabulary)
    join = lambda sep, a, b: sep.join(pick(ascii_) for _ in range(size(a, b)))

    def name() -> str:
        base = pick(("token", "secret", "password", "passwd", "api_key", "apikey", "secret_key", "access_key", "auth_token", "client_secret", "private_key", "db_password", "key", "credential"))
        return pick((base, base, f"{pick(ascii_)}_{base}", f"{base}_of_{join('_', 1, 3)}"))

    def value(kind: str) -> str:
        match kind:
            case "hex32" | "hex40" | "hex64":
                return chars(HEX, int(kind[3:]))
            case "b64":
                return chars(ALNUM + "+/", size(20, 88)) + pick(("", "=", "=="))
            case "alnum":
                return chars(ALNUM, size(16, 64))
            case "upper":
                return chars(ALNUM[:26] + "0123456789", size(16, 32))
            case "letters":
                return chars(ALNUM[:52] if rng.integers(2) else ALNUM[26:52], size(18, 40))
            case "prefixed":
                return pick(PREFIXES) + chars(ALNUM, size(16, 40))
            case "jwt":
                return ".".join(("eyJ" + chars(ALNUM, size(20, 40)), "eyJ" + chars(ALNUM, size(40, 160)), chars(ALNUM + "-_", 43)))
            case "password":
                return "".join((chars(ALNUM, size(3, 8)), pick("!#%&?_-+"), chars(ALNUM, size(3, 8)), pick(("", "!", "9"))))
            case "word_run":
                text = join("", 2, 5)
                return text if len(text) >= 16 else text + "".join(pick(ascii_) for _ in range(5))
            case "snake":
                return join("_", 2, 5) + pick(("", "", str(size(1, 9999))))
            case "digits":
                return chars("0123456789", size(16, 20))
            case "mail":
                return f"{pick(ascii_)}{pick(('.', '_', ''))}{pick(ascii_)}{pick(('', str(size(1, 99))))}@{join('.', 1, 2)}.{pick(('com', 'org', 'net', 'de', 'fr'))}"
            case "url":
                return f"https://{pick(ascii_)}.{pick(('com', 'org', 'io'))}/{join('/', 1, 4)}{pick(('', '.html', '?page=2'))}"
            case "path":
                return f"{pick(('/', './', '~/', '/etc/', '/home/'))}{join('/', 1, 4)}{pick(('', '.txt', '.pem', '.json', '.pub'))}"
            case "uuid":
                return "-".join(chars(HEX, k) for k in (8, 4, 4, 4, 12))
            case "call":
                return pick((f"get_{join('_', 1, 2)}({pick(ascii_)})", f"os.environ[{pick(ascii_).upper()}]", f"config.{join('.', 1, 3)}", f"{pick(ascii_)}.{pick(ascii_)}()", f"request.headers.get({pick(ascii_)})", f"{join('_', 2, 3)}("))
            case "sample":
                return pick((f"YOUR_{join('_', 1, 2).upper()}_HERE", f"your-{join('-', 1, 2)}", "changeme" + str(size(1, 99)), f"<{join('-', 1, 3)}>", f"example_{join('_', 1, 2)}", f"insert-{join('-', 1, 2)}-here", "xxxxxxxx" + "x" * size(0, 24), f"dummy{pick(ascii_)}", "placeholder", "REDACTED-" + pick(ascii_)))
            case "stars":
                return pick("*.x-#") * size(8, 24)
            case "variable":
                return pick((f"${{{join('_', 1, 3).upper()}}}", f"$({join('_', 1, 3)})", f"{{{{ {join('.', 1, 3)} }}}}".replace(" ", ""), f"%{join('_', 1, 2).upper()}%", f"${join('_', 2, 3).upper()}"))
            case "camel":
                return "".join(w.capitalize() for w in join(" ", 3, 5).split())
            case "version":
                return f"{join('-', 1, 2)}-{size(0, 20)}.{size(0, 20)}.{size(0, 99)}-{pick(('alpha', 'beta', 'release'))}"
            case "plain_key":
                return join(pick(("-", ".", "_")), 2, 4)
            case "rule":
                return pick("=-_/") * size(16, 60)
            case "date":
                return f"20{size(10, 30)}-0{size(1, 9)}-{size(10, 28)}T{size(10, 23)}:{size(10, 59)}:{size(10, 59)}.{size(100, 999)}Z"
            case _:  # caps
                return join("", 3, 5).upper()

    def finding(line: str, kind: str, secret: bool) -> tuple[str, str, str, bool]:
        v = value(kind)
        v = v if len(v) >= 8 else v + value("snake")
        filled = line.replace("{name}", name()).replace("{NAME}", name().upper())
        while "{w}" in filled:
            filled = filled.replace("{w}", word(), 1)
        v = v.capitalize() if "{V}" in filled else v
        before, _, after = filled.replace("{V}", "{v}").partition("{v}")
        before = f"{' '.join(word() for _ in range(size(0, 5)))}{pick((' ', chr(10)))}{before}"
        after = f"{after}{pick((' ', chr(10)))}{' '.join(word() for _ in range(size(0, 4)))}"
        return v, before[-CONTEXT:], after[:CONTEXT], secret

    out = []
    for _ in range(n):
        kind = pick(SECRET_KINDS)
        # a bare password or a run of letters says nothing without a name; hexadecimal alone may be any digest
        lines = SECRET_LINES if kind in ("alnum", "b64", "prefixed", "jwt", "letters") else SECRET_LINES[:-2]
        out.append(finding(pick(lines), kind, True))
        kind, line = pick(PLAIN_LINES)
        out.append(finding(line, kind, False))
    return out


FINDINGS = "doc_id long, begin long, end long, rule string, value_sha256 string, score double, is_secret boolean"


def scan(df: DataFrame, model: tuple[Lexicon, Forest] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row a candidate: doc_id, begin, end (code points), rule, value_sha256, score, is_secret (score >= ``least``).

    ``model`` is a lexicon and a forest trained with it; without one the words of all texts are counted and the forest is trained
    on labelled_findings().  The value itself is not returned.  A null or empty text has no candidates, and a document without any
    has no row.  Candidates are sought in whole texts, and are whole however long they are; rows that repeat an id are scanned each, and
    so are equal texts.  With an empty forest all candidates score 0.  An empty table gives an empty table.
    """
    if model is None:
        lex = lexicon(df, text_col)
        model = lex, train(labelled_findings(lex), lex)
    packed = df.sparkSession.sparkContext.broadcast(model)  # DICTIONARY words, and trees of the training set's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        lex, forest = packed.value
        for b in batches:
            found, x = [], []
            for i, t in zip(*(c.to_pylist() for c in b.columns)):
                for a, z, rule in candidates(t or ""):
                    found.append((i, a, z, rule, hashlib.sha256(t[a:z].encode("utf-8", "surrogatepass")).hexdigest()))
                    x.append(features(t[a:z], t[max(0, a - CONTEXT) : a], t[z : z + CONTEXT], lex))
            if found:
                for f, s in zip(found, forest.score(np.array(x)).tolist()):
                    yield (*f, s, s >= least)

    return map_rows(docs_of(df, id_col, (text_col, "text")), run, FINDINGS)
