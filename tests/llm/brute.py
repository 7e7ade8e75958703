"""Plain Python versions of what the operators return."""

import hashlib
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_base(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    at, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        for i in range(len(ws) - len(p) + 1):
            if ws[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def url(u):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0].translate(LOW)
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(v, h, p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    v, h, p = max(fits, key=lambda r: (r[1].count("."), len(r[2])), default=(None, "", ""))
    return host, path, h + p if v else None, v


def quality_base(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = {}
    for i in range(len(ws) - 2):
        count.setdefault(tuple(ws[i : i + 3]), []).append(i)
    covered = {i + k for at in count.values() if len(at) > 1 for i in at for k in range(3)}
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


SECRETS = {
    "assign": re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def secret_base(text):
    spans = []
    for o, (kind, rx) in enumerate(SECRETS.items()):
        for m in rx.finditer(text or ""):
            if {"assign": len(m[2] if kind == "assign" else "") >= 8, "access": len(m[0]) >= 16, "hex": len(m[0]) >= 32}[kind]:
                spans.append((m.start(), o, m.end(), kind))
    spans.sort()
    n = [sum(s[3] == k for s in spans) for k in SECRETS]
    return *n, hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans).encode()).hexdigest()
