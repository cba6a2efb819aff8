"""Members of C# source text, by a small lexer and brace matcher.

Comments, strings, characters and preprocessor lines are blanked first, so that braces can be matched. Classes in
namespaces (block or file-scoped) give their methods, properties, constructors and fields; a class in nested
namespaces is given once, under the full name. Structs, records, interfaces and enums give nothing, and neither do
classes outside namespaces.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quarry.schemas import ChunkingOptions

_TYPE = re.compile(r"\b(class|struct|record|interface|enum)\s+(?:struct\s+|class\s+)?(@?\w+)")
_NAMESPACE = re.compile(r"\bnamespace\s+([\w.]+)\s*$")
_CALL = re.compile(r"(?<![\w.])((?:\w+\s*(?:\?\.|\.)\s*)*\w+)\s*(?:<[\w\s,.<>?\[\]]*>)?\s*\(")
_NEW = re.compile(r"\bnew\s+([A-Za-z_][\w.]*)")
_STATEMENTS = {"if", "for", "foreach", "while", "switch", "catch", "using", "lock", "fixed", "return", "new", "throw", "when", "sizeof", "typeof", "default", "checked", "unchecked", "await", "in", "is", "and", "or", "not", "else", "do", "yield", "base", "this"}


@dataclass
class Member:
    namespace: str
    cls: str
    name: str
    kind: str
    text: str
    start: int
    end: int
    signature: str
    documentation: str
    class_documentation: str
    body: str
    body_line: int
    calls: list[str] = field(default_factory=list)
    attributes: str = ""


@dataclass
class Source:
    members: list[Member]
    controller: bool
    service: bool
    middleware: bool
    routes: dict[str, str]


_RAW = re.compile(r'[$@]*("""+)')
_QUOTED = re.compile(r'(?:\$@|@\$|@)"(?:[^"]|"")*"|\$?"(?:[^"\\\n]|\\.)*"' + r"|'(?:[^'\\\n]|\\.[^'\n]*)'")
_PLAIN = re.compile(r"""[^/#$@"']+""")


def mask(text: str) -> str:
    """The text with comments, literals and preprocessor lines blanked; lines and length stay."""
    out, i, n = [], 0, len(text)

    def blank(to: int) -> None:
        out.append("".join(c if c == "\n" else " " for c in text[i:to]))

    while i < n:
        if m := _PLAIN.match(text, i):
            out.append(m[0])
            i = m.end()
            continue
        rest = text[i : i + 2]
        if rest.startswith("//"):
            to = text.find("\n", i)
        elif rest.startswith("/*"):
            to = text.find("*/", i + 2) + 2 if text.find("*/", i + 2) >= 0 else -1
        elif rest[0] == "#" and not text[text.rfind("\n", 0, i) + 1 : i].strip():
            to = text.find("\n", i)
        elif m := _RAW.match(text, i):
            at = text.find(m[1], m.end())
            to = at + len(m[1]) if at >= 0 else -1
        elif m := _QUOTED.match(text, i):
            to = m.end()
        else:
            out.append(rest[0])
            i += 1
            continue
        to = n if to < 0 else to
        blank(to)
        i = to
    return "".join(out)


def _close(code: str, at: int) -> int:
    """The place after the brace that closes the one at this place."""
    depth = 0
    for i in range(at, len(code)):
        depth += {"{": 1, "}": -1}.get(code[i], 0)
        if not depth:
            return i + 1
    return len(code)


def _stop(code: str, at: int, end: int) -> tuple[int, str]:
    """Where a declaration's head ends, and how: '{', ';', '=>', '=', '}' or ''."""
    depth = 0
    while at < end:
        c = code[at]
        depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(c, 0)
        if not depth:
            if code[at : at + 2] == "=>":
                return at, "=>"
            if c in "{;}" or c == "=" and code[at + 1 : at + 2] != "=" and code[at - 1] not in "=!<>":
                return at, c
        at += 1
    return end, ""


def _semicolon(code: str, at: int, end: int) -> int:
    depth = 0
    while at < end:
        depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(code[at], 0)
        if code[at] == ";" and depth <= 0:
            return at + 1
        at += 1
    return end


def _attributes(code: str, at: int, end: int) -> int:
    """The place after leading attribute lists."""
    while at < end and (code[at].isspace() or code[at] == "["):
        if code[at] == "[":
            depth = 0
            while at < end:
                depth += {"[": 1, "]": -1}.get(code[at], 0)
                at += 1
                if not depth:
                    break
        else:
            at += 1
    return at


def _documentation(text: str, start: int) -> str:
    lines = text[:start].split("\n")[:-1]
    found = []
    while lines and lines[-1].strip().startswith("///"):
        found.append(lines.pop().strip())
    return "\n".join(reversed(found))


def parse(text: str) -> Source:
    code = mask(text)
    found = Source([], False, False, False, {})

    def line(at: int) -> int:
        return text.count("\n", 0, at) + 1

    def scan(at: int, end: int, namespace: str, cls: str, class_doc: str, route: str) -> None:
        while at < end:
            while at < end and (code[at].isspace() or code[at] in ";}"):
                at += 1
            if at >= end:
                return
            start, head_at = at, _attributes(code, at, end)
            stop, how = _stop(code, head_at, end)
            head = code[head_at:stop]
            if how == "" or how == "}":
                at = stop + 1
                continue
            if (m := _NAMESPACE.search(head)) and how in "{;":
                inner = f"{namespace}.{m[1]}" if namespace else m[1]
                if how == ";":
                    namespace, at = inner, stop + 1
                else:
                    at = _close(code, stop)
                    scan(stop + 1, at - 1, inner, "", "", "")
                continue
            if (m := _TYPE.search(head)) and "(" not in head[: m.start()]:
                if how != "{":
                    at = _semicolon(code, stop, end)
                    continue
                at = _close(code, stop)
                attributes = text[start:head_at]
                if m[1] == "class" and not re.search(r"\brecord\b", head) and namespace:
                    bases = head.split(":", 1)[1] if ":" in head else ""
                    found.controller |= "Controller" in bases or "ApiController" in attributes or "Route" in attributes
                    found.service |= m[2].endswith(("Service", "Repository")) or (m[2].startswith("I") and len(m[2]) > 1)
                    found.middleware |= "Middleware" in m[2] or "IMiddleware" in bases
                    prefix = re.search(r'\bRoute\s*\(\s*"([^"]*)"', attributes)
                    scan(stop + 1, at - 1, namespace, m[2], _documentation(text, start), prefix[1].rstrip("/") if prefix else "")
                else:
                    scan(stop + 1, at - 1, namespace, "", "", "")
                continue
            at = member(start, head_at, stop, how, end, namespace, cls, class_doc, route)

    def member(start: int, head_at: int, stop: int, how: str, end: int, namespace: str, cls: str, class_doc: str, route: str) -> int:
        head = code[head_at:stop]
        if how == "{":
            to = _close(code, stop)
            follow = re.match(r"\s*=(?!=)", code[to:end])
            if follow and "(" not in head:
                to = _semicolon(code, to, end)
        else:
            to = _semicolon(code, stop, end)
        if not cls or not namespace:
            return to
        call = re.search(r"(~?@?\w+)\s*(?:<[^()]*>)?\s*\(", head)
        words = head.split()
        body, body_line = "", 0
        if how == "{":
            first, last = text.rfind("\n", 0, stop) + 1, text.find("\n", to - 1)
            body, body_line = text[first : last if last >= 0 else len(text)], line(stop)
        elif how == "=>":
            body, body_line = text[stop + 2 : to - 1].strip(), line(stop)
        if call and not re.search(r"\b(operator|delegate|event)\b", head) and how in ("{", ";", "=>") and not call[1].startswith("~"):
            name = call[1]
            kind = "Constructor" if name == cls and not re.search(r"[\w>\]?]\s+$", re.sub(r"\b(public|private|protected|internal|static|extern|unsafe)\b", "", head[: call.start()])) else "Method"
            signature = re.sub(r"\s+", " ", text[head_at:stop]).strip()
        elif not call and how in ("{", "=>") and len(words) > 1 and "this" not in re.split(r"[\[\s]", head) and "event" not in words:
            kind, name = "Property", words[-1].split(".")[-1]
            signature = text[head_at:to].strip()
        elif how in (";", "=") and not call and "event" not in words and "delegate" not in words and len(words) > 1:
            kind, name = "Field", re.split(r"[\s,\[]", re.sub(r"<[^;=]*>", lambda m: m[0].replace(",", ";"), head).split(",")[0].strip())[-1]
            signature = text[head_at:to].strip()
        else:
            return to
        calls: list[str] = []
        if kind in ("Method", "Constructor") and body:
            inner = code[stop:to]
            for m in _CALL.finditer(inner):
                target = re.sub(r"\s+", "", m[1]).replace("?.", ".")
                if target.split(".")[-1] not in _STATEMENTS and not re.search(r"\bnew\s+$", inner[: m.start()]):
                    calls.append(target)
            if kind == "Method":
                calls += _NEW.findall(inner)
        attributes = text[start:head_at]
        found.members.append(Member(namespace, cls, name.lstrip("@"), kind, text[start:to], line(start), line(to - 1), signature, _documentation(text, start), class_doc, body, body_line, list(dict.fromkeys(calls)), attributes))
        if kind == "Method":
            routes = re.findall(r'\b(?:Route|Http\w+)\s*\(\s*"([^"]*)"', attributes)
            joined = [f"{route}/{r.lstrip('/')}" if route else r.lstrip("/") for r in routes]
            if joined:
                found.routes[f"{len(found.members) - 1}"] = ", ".join(joined)
        return to

    scan(0, len(code), "", "", "", "")
    order = {"Method": 0, "Property": 1, "Constructor": 2, "Field": 3}
    numbered = sorted(enumerate(found.members), key=lambda x: (x[1].namespace, x[1].cls, order[x[1].kind], x[0]))
    found.routes = {str(i): found.routes[str(old)] for i, (old, _) in enumerate(numbered) if str(old) in found.routes}
    found.members = [m for _, m in numbered]
    return found


def windows(body: str, options: ChunkingOptions) -> list[tuple[int, str]]:
    """(first line from 0, text) of windows that end at statements where they can; every line is in one of them."""
    lines = body.split("\n")
    if len(lines) <= options.max_lines or not body.strip():
        return [(0, body)]
    code, depth, ends = mask(body).split("\n"), 0, set()
    for i, text in enumerate(code):
        depth += sum({"{": 1, "}": -1, "(": 1, ")": -1}.get(c, 0) for c in text)
        if text.rstrip().endswith((";", "}")) and depth <= 1:
            ends.add(i)
    out, at = [], 0
    while True:
        to = min(at + options.max_lines, len(lines))
        if to < len(lines):
            to = next((e + 1 for e in range(to - 1, at + options.overlap_lines, -1) if e in ends), to)
        out.append((at, "\n".join(x.rstrip("\r") for x in lines[at:to])))
        if to == len(lines):
            return out
        at = max(to - options.overlap_lines, at + 1)


def chunks(path: str, text: str, options: ChunkingOptions = ChunkingOptions()) -> list[dict]:
    """Rows of a file's members, without ids, hashes and boosted content, which are expressions."""
    source, rows = parse(text), []
    for i, m in enumerate(source.members):
        method = m.kind == "Method"
        parts = windows(m.body, options) if method else [(0, m.body)]
        http = ", ".join(x[4:] for x in re.findall(r"\bHttp\w+", m.attributes)) if method else ""
        for k, (first, body) in enumerate(parts):
            split = len(parts) > 1
            start = m.body_line + first if split and k else m.start
            rows.append(
                {"FilePath": path, "NamespaceName": m.namespace, "ClassName": m.cls, "MemberName": m.name, "MemberType": m.kind, "Signature": m.signature, "Documentation": m.documentation, "ClassDocumentation": m.class_documentation,
                 "Body": body if m.kind in ("Method", "Constructor") else "", "StartLine": start, "EndLine": m.body_line + first + body.count("\n") if split else m.end,
                 "IsController": source.controller and m.kind in ("Method", "Property"), "IsService": source.service and m.kind != "Field", "IsMiddleware": source.middleware and method,
                 "BoostController": source.controller, "BoostService": source.service, "BoostMiddleware": source.middleware,
                 "HttpMethods": http or None, "RouteTemplate": source.routes.get(str(i)), "CallsTo": m.calls, "ChunkIndex": k, "TotalChunks": len(parts)}
            )
    return rows
