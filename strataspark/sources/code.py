"""Symbols, calls and imports of TypeScript, JavaScript, Go, Rust, Java, Kotlin and C# files, by a scanner that blanks
comments and strings, matches braces and reads declarations. It is no compiler: what it cannot tell it leaves out, and
the file's coverage says so."""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame

from strataspark.sources.documents import read_rows

ROWS = (
    "path string, row string, id string, name string, kind string, scope string, start_line int, end_line int, signature string, "
    "visibility string, target string, specifier string, tier string, coverage string"
)
_NAMES = [c.split()[0] for c in ROWS.split(", ")]

_ARGS = r"\s*(?:<[^<>()]*>)?\s*(?P<args>\([^()]*(?:\([^()]*\)[^()]*)*\))"
_TYPES_JAVA = r"\b(?P<kind>class|interface|enum|record|struct)\s+(?P<name>\w+)"
_METHOD_JAVA = r"(?m)(?:^|(?<=[{};]))[ \t]*(?:@\w+(?:\([^()]*\))?\s+)*(?P<mods>(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|sealed|synchronized|fun|open|suspend)\s+)*)(?:<[^<>]*>\s*)?(?:[\w.<>\[\],?]+\s+)?(?P<name>\w+)" + _ARGS + r"[^;{}=]*\{"
#: Declarations by language: (kind or None where the pattern has it, pattern, whether only inside a type).
DECLARATIONS = {
    "typescript": [
        (None, r"\b(?P<kind>class|interface|enum|namespace)\s+(?P<name>[\w$]+)", False),
        ("type", r"\btype\s+(?P<name>[\w$]+)\s*(?:<[^=]*>)?\s*=", False),
        ("function", r"\bfunction\s*\*?\s*(?P<name>[\w$]+)" + _ARGS, False),
        ("function", r"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?P<args>\([^()]*\)|[\w$]+)\s*(?::[^={;]+)?=>", False),
        ("method", r"(?m)(?:^|(?<=[{};]))[ \t]*(?P<mods>(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*)(?P<name>#?[\w$]+)" + _ARGS + r"\s*(?::[^{;]+)?\{", True),
    ],
    "go": [
        ("method", r"\bfunc\s+\(\s*\w*\s*\*?(?P<scope>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<name>\w+)" + _ARGS, False),
        ("function", r"\bfunc\s+(?P<name>\w+)" + _ARGS, False),
        (None, r"\btype\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?P<kind>struct|interface)\b", False),
    ],
    "rust": [(None, r"\b(?P<kind>struct|enum|trait|mod)\s+(?P<name>\w+)", False), ("impl", r"\bimpl\b(?:\s*<[^{>]*>)?\s+(?:[\w:<>, ']+\s+for\s+)?(?P<name>\w+)", False), ("function", r"\bfn\s+(?P<name>\w+)" + _ARGS, False)],
    "java": [(None, _TYPES_JAVA, False), ("method", _METHOD_JAVA, True)],
}
LANGUAGE_OF = {"ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "go": "go", "rs": "rust", "java": "java", "kt": "java", "cs": "java"}
IMPORTS = {
    "typescript": [r"""\bimport\s+(?:type\s+)?(?P<names>[^'";]*?)\s*from\s*['"](?P<spec>[^'"]+)['"]""", r"""\bimport\s*['"](?P<spec>[^'"]+)['"]""", r"""\b(?:const|let|var)\s+(?P<names>[^=;]+?)\s*=\s*require\(\s*['"](?P<spec>[^'"]+)['"]"""],
    "go": [r"""\bimport\s+(?P<names>\w+\s+)?"(?P<spec>[^"]+)\"""", r"""(?m)^\s+(?P<names>\w+\s+)?"(?P<spec>[\w./-]+)"\s*$"""],
    "rust": [r"\buse\s+(?P<spec>[\w:]+)(?:::\{(?P<names>[^}]*)\})?\s*(?:as\s+\w+)?;"],
    "java": [r"\b(?:import|using)\s+(?:static\s+)?(?P<spec>[\w.]+)\s*;?"],
}
#: Words before a parenthesis that call nothing.
KEYWORDS = set("if for while switch catch return function func fn new typeof sizeof super await yield throw assert when lock using synchronized".split())
HIDDEN = {"private", "protected", "internal"}


def blanked(text: str, language: str) -> str:
    """The text with comments and the insides of strings turned to blanks; line ends stay."""
    quote = r'"(?:[^"\\\n]|\\.)*"' + ("" if language == "rust" else r"|'(?:[^'\\\n]|\\.)*'") + (r"|`(?:[^`\\]|\\.)*`" if language in ("typescript", "go") else "")
    return re.sub(rf"//[^\n]*|/\*.*?\*/|{quote}", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def braces(text: str) -> tuple[dict[int, int], bool]:
    """Where each opening brace closes, and whether all do."""
    open_, out, good = [], {}, True
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
        else:
            good = False
    return out, good and not open_


def read_code(path: str, content: str):
    """Rows of one file: `file` (coverage), `symbol`, `import` and `edge`. Calls are resolved in this order: a local
    callable of that name (`local`), an imported name (`imported-name`), a method of the same type through this or self
    (`this-method`), a method of a local type through a variable made or declared with it (`typed-receiver`)."""
    language = LANGUAGE_OF.get(path.rsplit(".", 1)[-1].lower())
    if language is None:
        return

    def row(what, **values):
        return tuple(({"path": path, "row": what} | values).get(n) for n in _NAMES)

    text = blanked(content, language)
    closes, balanced = braces(text)
    opens = sorted(closes)
    starts = [0, *[m.end() for m in re.finditer("\n", text)]]
    line = lambda at: bisect_right(starts, at)
    found = []  # (start, end, kind, name, scope, args, mods)
    for kind, pattern, _inside in DECLARATIONS[language]:
        for m in re.finditer(pattern, text):
            g = m.groupdict()
            if g["name"] in KEYWORDS:
                continue
            head = m.end() - 1 if text[m.end() - 1] == "{" else next((o for o in opens[bisect_right(opens, m.end() - 1):][:1] if not re.search(r"[;}]", text[m.end() : o])), None)
            end = closes.get(head, m.end()) if head is not None else m.end()
            at = m.start("name")
            before = text[max(0, at - 80) : at].split("\n")[-1].split(";")[-1].split("}")[-1]
            found.append([at, end, kind or {"record": "class", "mod": "module"}.get(g["kind"], g["kind"]), g["name"], g.get("scope"), g.get("args"), before, _inside])
    types = [f for f in found if f[2] in ("class", "interface", "struct", "enum", "trait", "impl", "namespace")]
    kept, seen = [], set()
    for f in sorted(found, key=lambda f: (f[0], f[7])):
        if f[0] in seen or f[2] == "impl":
            continue
        around = [t for t in types if t[0] < f[0] < t[1]]
        owner = min(around, key=lambda t: t[1] - t[0])[3] if around else None
        if f[7] and owner is None:
            continue
        if f[7] and any(k[2] in ("method", "function") and k[0] < f[0] < k[1] for k in kept):
            continue  # a statement inside a body looks like a method
        if f[2] == "function" and owner and language == "rust":
            f[2] = "method"
        if f[2] == "method":
            f[4] = f[4] or owner
        seen.add(f[0])
        kept.append(f)
    ids = {}
    for f in kept:
        name = f[3]
        public = (name[:1].isupper() if language == "go" else "pub" in f[6].split() if language == "rust" else not (HIDDEN & set(f[6].split())) and not name.startswith("#"))
        sid = f"{path}#method:{f[4]}.{name}" if f[2] == "method" else f"{path}#{f[2]}:{name}"
        ids.setdefault((f[4] if f[2] == "method" else None, name), sid)
        yield row("symbol", id=sid, name=name, kind=f[2], scope=f[4] if f[2] == "method" else None, start_line=line(f[0]), end_line=line(f[1]), signature=re.sub(r"\s+", " ", f[5] or "").strip(), visibility="public" if public else "private")
    imported = {}
    for pattern in IMPORTS[language]:
        for m in re.finditer(pattern, content):
            if text[m.start() : m.start() + 3].strip() == "" and language != "go":
                continue  # inside a comment or string
            spec, names = m["spec"], (m.groupdict().get("names") or "")
            plain = [w.split()[-1] for w in re.sub(r"[{}*]", " ", names).replace(" as ", " ").split(",") if w.split()]
            for w in plain or [re.split(r"[/.:]", spec)[-1]]:
                imported.setdefault(w, spec)
            yield row("import", specifier=spec, start_line=line(m.start()), name=",".join(plain))
    made = {}
    for m in re.finditer(r"\b(?:const|let|var|final|auto)?\s*([\w$]+)\s*(?::\s*([\w$]+))?\s*(?::=|=)\s*(?:new\s+)?&?([\w$]+)\s*[({]|\b([A-Z]\w*)\s+([\w$]+)\s*=\s*new\b", text):
        var, owner = (m[1], m[2] or m[3]) if m[1] else (m[5], m[4])
        made.setdefault(var, owner)
    bodies = [f for f in kept if f[2] in ("function", "method")]
    told = set()
    for m in re.finditer(r"(?P<new>\bnew\s+)?(?:(?P<recv>[\w$]+)\s*(?:\.|::|->)\s*)?(?P<name>[\w$#]+)\s*(?:<[\w, ]*>)?\(", text):
        name, recv, at = m["name"], m["recv"], m.start("name")
        inside = [f for f in bodies if f[0] < at < f[1]]
        if not inside or name in KEYWORDS or any(f[0] == at for f in kept):
            continue
        f = min(inside, key=lambda f: f[1] - f[0])
        caller = f"{path}#method:{f[4]}.{f[3]}" if f[2] == "method" else f"{path}#{f[2]}:{f[3]}"
        target = tier = None
        if recv in ("this", "self", "Self"):
            target, tier = ids.get((f[4], name)), "this-method"
        elif recv is None:
            if (None, name) in ids:
                target, tier = ids[None, name], "local"
            elif name in imported:
                target, tier = f"{imported[name]}#{name}", "imported-name"
        elif recv in made and (made[recv], name) in ids:
            target, tier = ids[made[recv], name], "typed-receiver"
        elif (recv, name) in ids:
            target, tier = ids[recv, name], "local"
        elif recv in imported:
            target, tier = f"{imported[recv]}#{name}", "imported-name"
        if target and target != caller and (caller, target, tier) not in told:
            told.add((caller, target, tier))
            yield row("edge", id=caller, kind="calls", target=target, tier=tier, start_line=line(at), coverage="verified" if tier != "imported-name" else "partial")
    dynamic = re.search(r"\beval\s*\(|\bimport\s*\(|\bnew\s+Function\s*\(", text)
    odd = not balanced or re.search(r"\bReflect\.|\breflect\.|Class\.forName|\[\s*[\w$]+\s*\]\s*\(|\bunsafe\b", text)
    yield row("file", coverage="unknown" if dynamic else "partial" if odd else "verified", kind=language)


def code_rows(docs: DataFrame) -> DataFrame:
    """ROWS of docs(path, content); files of other languages give none."""
    return read_rows(docs, read_code, ROWS)


#: Adapters by id: what turns (path, content) into rows of ROWS.
ADAPTERS: dict = {"braces": read_code}


def adapter(adapter_id: str):
    """Register a language adapter: a generator over (path, content) of tuples in the order of ROWS."""

    def add(f):
        ADAPTERS[adapter_id] = f
        return f

    return add


def analyse(docs: DataFrame) -> DataFrame:
    """The rows of all registered adapters, in the order of their ids."""
    out = [read_rows(docs, ADAPTERS[a], ROWS) for a in sorted(ADAPTERS)]
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows
