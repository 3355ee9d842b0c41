"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are values after an assignment sign, values inside those (of query and connection strings), runs of token
characters, and keys with a well-known opening. The forest judges each, inner ones included, by its length, the transitions between its characters, the part of it that dictionary words
cover, the path it comes from and the words beside it. It is trained here on labelled findings: by default on
`FINDINGS` generated ones (keys, tokens and passwords against placeholders, checksums, identifiers and prose), or
on a labelled table of the caller's. The trees are arrays; scoring is one narrow pass over whole texts.

Defined results: null and empty texts have no candidates; candidates may overlap; of overlapping ones that the
forest keeps one is a finding: well-known keys first, assigned values next, then the longest; repeated rows give repeated rows; a missing path is the empty path; other columns are not read; an empty table gives no rows.
Values themselves do not reach the result, only their places and hashes.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import table

FINDINGS = 6000
TREES, DEPTH, LEAF = 40, 9, 4
LEAST_SCORE = 0.5
ASSIGNED = re.compile(r"""[:=]>?[ \t]*["'`]?([^\s"'`,;<>(){}\[\]]{8,})""")
#: Values within a longer one: they end where a part of a URL ends.
INNER = re.compile(r"""(?<=[:=])(?!/)[^\s"'`,;<>(){}\[\]&?#@:=]{8,}={0,2}""")
LOGIN = re.compile(r"://[^\s/@:]*:$")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Openings of well-known keys.
KNOWN = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})")
#: Parts of a signed token are joined by dots, so a run of their characters is looked into only if two more follow.
RUN = re.compile(r"[A-Za-z0-9_-]+")
SIGNED = re.compile(r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{10}")
OPENED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})")
SECRET_WORDS = frozenset("token secret password passwd pwd key apikey api auth credential private access bearer signing".split())
HARMLESS_WORDS = frozenset("commit sha sha1 sha256 md5 checksum digest hash revision rev blob tree uuid guid id example sample test dummy placeholder url http https href src version build etag".split())
HARMLESS_PATH = frozenset("test tests example examples docs fixture fixtures sample mock lock vendor dist".split())
DICTIONARY = frozenset(
    "the and for with you your this that from have not are was will can all new use user name time data file line value key token secret "
    "password test example sample change here insert replace default none null true false admin root login server local host home path "
    "config http https www com org net api app web site page main index code word text list item string number first last start end "
    "get set put post add del run make build read write open close load save send copy move view edit help about contact mail".split()
)
CONTEXT = 48
NAMES = ("length", "digits", "uppers", "switches", "entropy", "repeats", "runs", "hex", "dictionary", "vowels", "secret_word", "harmless_word", "harmless_path", "assigned", "quoted", "known", "login")


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def covered(value: str) -> float:
    """The part of a value's characters that dictionary words cover, longest first."""
    low, at, hit = value.lower(), 0, 0
    while at < len(low):
        for size in range(min(9, len(low) - at), 2, -1):
            if low[at : at + size] in DICTIONARY:
                hit += size
                at += size
                break
        else:
            at += 1
    return hit / len(value)


def features(value: str, before: str, after: str, path: str, assigned: bool) -> list[float]:
    n = len(value)
    kinds = [_class(c) for c in value]
    counts: dict[str, int] = {}
    for c in value:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    steps = [ord(b) - ord(a) for a, b in zip(value, value[1:])]
    near = set(re.findall(r"[a-z0-9]+", before.lower().replace("_", " "))[-4:]) | set(re.findall(r"[a-z0-9]+", after.lower())[:2])
    where = set(re.findall(r"[a-z0-9]+", path.lower()))
    return [
        float(min(n, 400)),
        kinds.count(0) / n,
        kinds.count(2) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        entropy,
        max(counts.values()) / n,
        sum(s in (0, 1) for s in steps) / n,
        float(all(c in string.hexdigits or c == "-" for c in value)),
        covered(value),
        sum(c in "aeiouAEIOU" for c in value) / n,
        float(bool(near & SECRET_WORDS)),
        float(bool(near & HARMLESS_WORDS)),
        float(bool(where & HARMLESS_PATH)),
        float(assigned),
        float(before[-1:] in "\"'`" if before else False),
        float(bool(KNOWN.match(value))),
        float(after[:1] == "@" and bool(LOGIN.search(before))),
    ]


def signed_tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of three dotted runs of at least ten characters, the first after `eyJ`: each run is looked at once."""
    runs = [m.span() for m in RUN.finditer(text)] if "eyJ" in text else []
    out, passed = [], 0
    for (s, e), (s2, e2), (s3, e3) in zip(runs, runs[1:], runs[2:]):
        if s2 == e + 1 and s3 == e2 + 1 and text[e] == text[e2] == "." and min(e2 - s2, e3 - s3) >= 10 and (m := SIGNED.search(text, max(s, passed), e)):
            out.append((m.start(), e3))
            passed = e3
    return out


def candidates(text: str | None) -> list[tuple[int, int, bool]]:
    """(start, end, assigned), in order, each place once; those inside others too.

    Where a run of token characters is a name, a sign and an assigned value, the name stands for itself.
    """
    if not text:
        return []
    values = {m.span(): True for m in INNER.finditer(text)} | {m.span(1): True for m in ASSIGNED.finditer(text)}
    ends: dict[int, int] = {}
    for s, e in values:
        ends[s] = max(e, ends.get(s, 0))
    starts = sorted(ends)
    found = {m.span(): False for m in OPENED.finditer(text)} | {span: False for span in signed_tokens(text)}
    for m in TOKEN.finditer(text):
        s, e = m.span()
        at = bisect(starts, s)
        if at < len(starts) and starts[at] < e <= ends[starts[at]]:
            e = s + len(text[s : starts[at]].rstrip("="))
            if not TOKEN.fullmatch(text, s, e):
                continue
        found[s, e] = False
    return sorted((s, e, assigned) for (s, e), assigned in (found | values).items())


def without_overlaps(kept: list[tuple[int, int, int]]) -> list[int]:
    """Which of the (start, end, rank) stay, in order of their places: the highest rank first, then the longest."""
    starts: list[int] = []
    out: list[int] = []
    for i in sorted(range(len(kept)), key=lambda i: (-kept[i][2], kept[i][0] - kept[i][1], kept[i][0])):
        at = bisect(starts, kept[i][0])
        if (at == 0 or kept[out[at - 1]][1] <= kept[i][0]) and (at == len(out) or kept[i][1] <= starts[at]):
            starts.insert(at, kept[i][0])
            out.insert(at, i)
    return out


def around(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]


def _in_url(r: random.Random, pick, word, known: list[str], label: int) -> tuple[str, str, str, str, bool, int]:
    """A generated finding in a query string, a connection string or a path."""
    alnum = string.ascii_letters + string.digits
    host = f"{word()}.{word()}.{r.choice(('com', 'org', 'net'))}"
    lead = r.choice(("see ", "url=", "href=", "DATABASE_URL=", word() + " ", ""))
    path = r.choice(("src/app", "config/prod", "", "src1", "deploy/env", "src4"))
    if r.random() < 0.4:
        before, after = f"{lead}{r.choice(('postgres', 'mysql', 'amqp', 'redis', 'https'))}://{word()}:", f"@{host}/{word()}"
        if label:
            value = pick(alnum + "!%*+-^_~", r.randint(8, 24)) if r.random() < 0.7 else pick("0123456789abcdef", r.choice((16, 32, 40)))
        else:
            value = r.choice(("password", "changeme", "xxxxxxxx", "your_password", "password123", "secretpassword", "********", "example_password"))
        return value, before, after, path, True, label
    query = f"{lead}https://{host}/{word()}?{word()}={r.choice((word(), pick('0123456789', 2)))}&"
    if label:
        value = r.choice((lambda: pick("0123456789abcdef", r.choice((32, 40, 64))), lambda: pick(alnum, r.randint(20, 64)), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(alnum, 36)))()
        name = r.choice(("token", "secret", "api_key", "access_key", "auth_token", "key", "password", "apikey"))
        return value, f"{query}{name}=", r.choice(("", f"&{word()}={word()}", " " + word())), path, True, 1
    kind = r.randrange(4)
    if kind == 0:  # the whole URL, with or without a key in it
        value = f"//{host}/{word()}?{word()}={word()}&{r.choice(('token', 'key', 'access_key', word()))}={pick(alnum, r.randint(4, 40))}"
        return value, f"{lead}https:", " " + word(), path, True, 0
    if kind == 1:
        value, name = r.choice((pick("0123456789abcdef", 40), "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)))), r.choice(("id", "uuid", "commit", "sha", "etag", "rev"))
    elif kind == 2:
        value, name = r.choice(("your_api_key_here", "changeme", "xxxxxxxxxxxxxxxx", "REPLACE_WITH_KEY", "insert-token-here")), r.choice(("token", "key", "api_key"))
    else:
        value, name = r.choice(("_".join(word() for _ in range(3)), "".join(r.choice(known) for _ in range(3)), f"{pick('0123456789', 4)}/{word()}/{word()}")).ljust(8, "e"), word()
    return value, f"{query}{name}=", r.choice(("", f"&{word()}={word()}", " " + word())), path, True, 0


def labelled_findings(n: int = FINDINGS, seed: int = 11) -> list[tuple[str, str, str, str, bool, int]]:
    """Generated (value, before, after, path, assigned, label): about half of each label."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    word = lambda: pick(string.ascii_lowercase, r.randint(2, 9))
    known = sorted(DICTIONARY)
    prose = lambda k: " ".join(word() if r.random() < 0.7 else r.choice(known) for _ in range(k))
    # a made-up word with digits, another one, and signs: what people choose
    password = lambda: f"{r.choice((word(), word().capitalize()))}{pick(string.digits, r.randint(1, 4))}{r.choice(('', word()))}{pick('!#$%&*?@_', r.randint(1, 4))}".ljust(8, "7")
    alnum, b64, hexa = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef"
    out = []
    for i in range(n):
        quoted = r.choice(['"', "'", ""])
        if i >= n - n // 6:  # parts of URLs
            out.append(_in_url(r, pick, word, known, i % 2))
            continue
        if i % 2:
            value = r.choice((
                lambda: pick(hexa, r.choice((32, 40, 64))), lambda: pick(hexa.upper(), r.choice((32, 40))),
                lambda: pick(alnum, r.randint(20, 64)), lambda: pick(b64, r.randint(24, 60)) + "=" * r.randint(0, 2),
                lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(alnum, 36),
                lambda: pick(alnum + "!#%&*+-?@^_~", r.randint(10, 24)), password,
            ))()
            if len(value) < 20 or r.random() < 0.85:  # shorter ones are candidates only after a sign
                name = r.choice(("token", "secret", "api_key", "password", "auth_token", "access_key", "private_key", "API_KEY", "passwd"))
                before, assigned = f"{prose(3)} {name} {r.choice((':', '=', ' = ', ': '))}{quoted}", True
            else:
                before, assigned = f"{prose(3)} {r.choice(('bearer', 'secret', 'token', 'key'))} {quoted}", False
            path = r.choice(("src/app", "config/prod", "", "src1", "deploy/env"))
            out.append((value, before, quoted + " " + prose(2), path, assigned, 1))
            continue
        kind = r.randrange(7)
        path = r.choice(("src/app", "", "tests/fixtures", "docs/examples", "src4"))
        if kind == 0:
            value = r.choice(("changeme", "your_api_key_here", "xxxxxxxxxxxxxxxx", "insert-token-here", "00000000000000000000", "password123", "<your-secret>".strip("<>"), "REPLACE_WITH_KEY", "exampleexampleexample", "test" * r.randint(3, 8)))
            before, assigned = f"{prose(2)} {r.choice(('token', 'password', 'api_key'))} = {quoted}", True
        elif kind == 1:
            value, assigned = pick(hexa, r.choice((32, 40, 64))), r.random() < 0.5
            before = f"{prose(2)} {r.choice(('commit', 'sha256', 'md5', 'checksum', 'revision', 'etag'))}{r.choice((' ', ': ', '='))}"
        elif kind == 2:
            value, assigned = "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), r.random() < 0.5
            before = f"{prose(2)} {r.choice(('id', 'uuid', 'request id'))}{r.choice((' ', '=', ': '))}"
        elif kind == 3:
            value, assigned = "".join(word() for _ in range(r.randint(3, 6)))[:60].ljust(20, "e"), False
            before = prose(4) + " "
        elif kind == 4:
            value, assigned = "//" + word() + "." + word() + ".example.com/" + "/".join(word() for _ in range(3)), True
            before = prose(3) + " http:"
        elif kind == 5:
            value, assigned = r.choice((word() * 4, "".join(r.choice(known) for _ in range(5)), "_".join(word() for _ in range(4)))).ljust(20, "-"), r.random() < 0.5
            before = f"{prose(2)} {word()}{' = ' if assigned else ' '}"
        else:
            value, assigned = r.choice(("=", "-", "_", "/", "0")) * r.randint(20, 70), False
            before = prose(2) + " "
        out.append((value, before, " " + prose(2), path, assigned, 0))
    return out


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at leaves), threshold, left and right child, value."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=np.int32)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                go = x[np.arange(len(x)), f] <= threshold[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += value[at]
        return total / max(len(self.trees), 1)


def _split(x: np.ndarray, y: np.ndarray, features_: np.ndarray) -> tuple[float, int, float]:
    """The split with the least Gini impurity among some features: (impurity, feature, threshold)."""
    best = (math.inf, -1, 0.0)
    n = len(y)
    for f in features_:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        k = np.arange(1, n)
        cut = (v[1:] > v[:-1]) & (k >= LEAF) & (n - k >= LEAF)
        if not cut.any():
            continue
        k, a = k[cut], ones[:-1][cut]
        b = ones[-1] - a
        gini = (k - (a * a + (k - a) ** 2) / k + (n - k) - (b * b + (n - k - b) ** 2) / (n - k)) / n
        i = int(gini.argmin())
        if gini[i] < best[0]:
            at = int(np.flatnonzero(cut)[i])
            best = (float(gini[i]), int(f), float((v[at] + v[at + 1]) / 2))
    return best


def train_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> Forest:
    out = []
    for t in range(trees):
        rng = np.random.Generator(np.random.Philox([seed, t]))
        rows = rng.integers(0, len(y), len(y))
        nodes: list[list] = []

        def grow(ids: np.ndarray, level: int) -> int:
            at = len(nodes)
            p = float(y[ids].mean()) if len(ids) else 0.0
            nodes.append([-1, 0.0, -1, -1, p])
            if level < depth and 0 < p < 1 and len(ids) >= 2 * LEAF:
                some = rng.choice(x.shape[1], size=max(1, int(math.sqrt(x.shape[1])) + 1), replace=False)
                _, f, threshold = _split(x[ids], y[ids], some)
                if f >= 0:
                    low = x[ids, f] <= threshold
                    nodes[at][:2] = [f, threshold]
                    nodes[at][2] = grow(ids[low], level + 1)
                    nodes[at][3] = grow(ids[~low], level + 1)
            return at

        grow(rows, 0)
        c = list(zip(*nodes))
        out.append((np.array(c[0], np.int32), np.array(c[1]), np.array(c[2], np.int32), np.array(c[3], np.int32), np.array(c[4])))
    return Forest(out)


def learn(findings: list[tuple[str, str, str, str, bool, int]] | None = None) -> Forest:
    findings = labelled_findings() if findings is None else findings
    x = np.array([features(*f[:5]) for f in findings]).reshape(len(findings), len(NAMES))
    return train_forest(x, np.array([f[5] for f in findings], dtype=float))


def learn_from_table(findings: DataFrame, rows: int = 20_000) -> Forest:
    """From value, before, after, path, assigned, label: at most `rows` of them, those with the smallest hashes."""
    cols = ["value", "before", "after", "path", "assigned", "label"]
    got = findings.select(*cols).dropna().filter(F.length("value") > 0).orderBy(F.xxhash64(*cols), *cols).limit(rows).collect()
    return learn([tuple(r) for r in got])


RESULT = "doc_id long, n_candidates long, n_secrets long, max_score double, findings array<struct<start:long,stop:long,score:double,sha256:string>>"


def scan_secrets(docs: DataFrame, forest: Forest, least: float = LEAST_SCORE, path_column: str = "source") -> DataFrame:
    """doc_id, n_candidates, n_secrets, max_score (null without candidates), findings that the forest keeps."""
    finding = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("sha256", pa.string())])
    fields = pa.schema([
        ("doc_id", pa.int64()), ("n_candidates", pa.int64()), ("n_secrets", pa.int64()), ("max_score", pa.float64()), ("findings", pa.list_(finding)),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, paths = b.column(1), b.column(2).to_pylist()
            found, x = [], []
            for t, path in zip(texts, paths):
                text = t.as_py()
                mine = candidates(text)
                found.append((text, mine))
                x += [features(text[s:e], *around(text, s, e), path or "", assigned) for s, e, assigned in mine]
            scores = forest.score(np.array(x)) if x else np.empty(0)
            at, out = 0, []
            for d, (text, mine) in zip(b.column(0).to_pylist(), found):
                own = [round(float(v), 9) for v in scores[at : at + len(mine)]]
                at += len(mine)
                passed = [(s, e, v, 2 if KNOWN.fullmatch(text, s, e) else int(assigned)) for (s, e, assigned), v in zip(mine, own) if v >= least]
                passed = [passed[i] for i in without_overlaps([(s, e, rank) for s, e, _, rank in passed])]
                kept = [{"start": s, "stop": e, "score": v, "sha256": hashlib.sha256(text[s:e].encode("utf-8", "surrogatepass")).hexdigest()} for s, e, v, _ in passed]
                out.append({"doc_id": d, "n_candidates": len(mine), "n_secrets": len(kept), "max_score": max(own, default=None), "findings": kept})
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    where = F.col(path_column).cast("string") if path_column in docs.columns else F.lit("")
    return docs.select("doc_id", "text", where.alias("path")).mapInArrow(run, RESULT)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), learn())
