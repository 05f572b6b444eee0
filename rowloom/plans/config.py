"""The description language: tags and quoted attributes, read into a tree."""
from __future__ import annotations

import re

from ..functions.compute import Node

_PART = re.compile(r"<!--.*?-->|<(?P<close>/)?(?P<tag>[A-Za-z_]\w*)(?P<attrs>(?:\s+[A-Za-z_]\w*\s*=\s*\"[^\"]*\")*)\s*(?P<empty>/)?>", re.S)
_ATTR = re.compile(r"([A-Za-z_]\w*)\s*=\s*\"([^\"]*)\"", re.S)


class ConfigError(ValueError):
    """What is wrong, with a code that stays the same when the wording does not."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def _plain(s: str) -> str:
    return s.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&amp;", "&")


def read(text: str) -> Node:
    """The root element. Text between tags stays with the element; that of `data` as it is, of others trimmed."""
    root, stack, at = None, [], 0
    for m in _PART.finditer(text):
        between = text[at:m.start()]
        if "<" in between:
            raise ConfigError("E005", f"this is no tag: {between[between.index('<'):][:40]!r}; attributes need double quotes, and < in text is written &lt;")
        if stack:
            stack[-1].text += _plain(between)
        elif between.strip():
            raise ConfigError("E001", f"text outside of any tag: {between.strip()[:30]!r}")
        at = m.end()
        if m["tag"] is None:
            continue
        if m["close"]:
            if not stack or stack[-1].tag != m["tag"]:
                raise ConfigError("E002", f"</{m['tag']}> closes nothing")
            done = stack.pop()
            done.text = done.text if done.tag == "data" else done.text.strip()
            continue
        node = Node(m["tag"], {k: _plain(v) for k, v in _ATTR.findall(m["attrs"] or "")}, [])
        if stack:
            stack[-1].children.append(node)
        elif root is None:
            root = node
        else:
            raise ConfigError("E003", "more than one root element")
        if not m["empty"]:
            stack.append(node)
    if stack or root is None:
        raise ConfigError("E004", f"<{stack[-1].tag}> is not closed" if stack else "no element")
    if text[at:].strip():
        raise ConfigError("E001", "text after the last tag")
    return root


_FIXED = ("before", "after", "before_block", "after_block", "delimiter_block", "before_line", "after_line", "delimiter_line")
TAGS = {tag: {"line", "data"} for tag in _FIXED} | {
    "tdc": {"env", "block"}, "data_set": {"env", "block"},
    "env": {"sequence", "mix", "switch", "pool", "distinct", "uniq", "assert", "before", "after", "before_block", "after_block", "delimiter_block", "before_line", "after_line", "delimiter_line"},
    "block": {"line"}, "line": {"data"}, "pool": {"sequence", "mix", "switch", "distinct", "uniq"},
    "sequence": {"gen", "data", "compute", "distinct"}, "mix": {"case"}, "case": {"gen", "data", "switch", "compute"}, "switch": {"map", "case", "default"}, "default": {"gen", "data", "compute", "switch"},
}
#: Attributes that a tag takes.
ATTRIBUTES = {
    "tdc": "version v regex_max_length comment", "data_set": "version v regex_max_length comment", "env": "count seed local inject mode engine comment",
    "sequence": "name parent uniq comment", "mix": "name parent percent flag comment", "switch": "name parent on comment", "pool": "name count comment", "case": "is anomaly percent comment", "default": "comment", "map": "comment",
    "distinct": "of comment", "uniq": "of comment", "assert": "that says comment", "block": "comment", "line": "if each comment", "data": "name value type if pair comment",
} | {t: "if comment" for t in ("before", "after", "before_block", "after_block", "delimiter_block", "before_line", "after_line", "delimiter_line")}
#: Attributes that any generator takes, and those of each type.
EVERY = "type name if comment missing missing_as anomaly anomaly_factor anomaly_flag mask case repeat separator lengths distinct accumulate"
OF_TYPE = {
    "text": "value percent order cycle", "number": "value percent length first_zero include exclude decimals distribution min max mean sd meanlog sdlog rate alpha xmin shape scale lambda n s beta",
    "increment": "value step", "decrement": "value step", "symbol": "value alphabet length include exclude", "regex": "value", "advanced_regex": "value",
    "date": "value format from to range oldest youngest precision local order cycle step weekdays of plus", "template": "value local format from to range oldest youngest precision order cycle percent",
    "file": "src column header delimiter row weight read sample decimals order cycle percent", "timeseries": "base trend period amplitude peak_at noise decimals",
    "pattern": "src points upper lower mode y_range fit interp spread ink_threshold decimals", "running": "of accumulate base reset", "stat": "of op decimals", "formula": "expr decimals",
    "pool": "value filter", "http": "src in on_error timeout secret",
}
#: What a type can't do without: one of each group.
NEEDS = {"text": ["value"], "symbol": ["value alphabet"], "regex": ["value"], "advanced_regex": ["value"], "template": ["value"], "file": ["src"], "pattern": ["src points upper", "y_range"], "running": ["of"], "stat": ["of", "op"], "formula": ["expr"], "pool": ["value"], "http": ["src"]}
TYPES = {"text", "number", "increment", "decrement", "symbol", "regex", "advanced_regex", "date", "template", "file", "timeseries", "pattern", "running", "stat", "formula", "pool", "http"}


def validate(root: Node) -> list[ConfigError]:
    """All that is wrong with a tree, before anything runs."""
    out: list[ConfigError] = []
    env = next((c for c in root.children if c.tag == "env"), None)
    if env is None:
        return [ConfigError("E010", "there is no <env>")]
    count = env.attrs.get("count")
    if count is not None and (not count.isdigit()):
        out.append(ConfigError("E020", f"count must be a whole number of 0 or more, not {count!r}"))
    seen: set[str] = set()

    def visit(node: Node):
        for c in node.children:
            if node.tag in TAGS and c.tag not in TAGS[node.tag]:
                out.append(ConfigError("E011", f"<{c.tag}> does not belong in <{node.tag}>"))
            if c.tag in ATTRIBUTES and (odd := c.attrs.keys() - set(ATTRIBUTES[c.tag].split())):
                out.append(ConfigError("E018", f"<{c.tag}> takes no {', '.join(sorted(odd))}"))
            if c.tag in ("sequence", "mix", "switch", "case", "default") and not c.children and not (c.tag in ("case", "default") and c.text):
                out.append(ConfigError("E017", f"<{c.tag}> {c.attrs.get('name', '')} is empty"))
            if c.tag == "gen":
                kind = c.attrs.get("type")
                # a template may hand on parameters of its own, by any name
                if kind in OF_TYPE and kind != "template" and (odd := c.attrs.keys() - set(f"{EVERY} {OF_TYPE[kind]}".split())):
                    out.append(ConfigError("E018", f"a {kind} generator takes no {', '.join(sorted(odd))}"))
                for group in NEEDS.get(kind, ()):
                    if not set(group.split()) & c.attrs.keys():
                        out.append(ConfigError("E019", f"a {kind} generator needs {' or '.join(group.split())}"))
                if kind not in TYPES:
                    out.append(ConfigError("E012", f"no generator is named {kind!r}"))
                for a in ("missing", "anomaly"):
                    if a in c.attrs:
                        try:
                            ok = 0 <= float(c.attrs[a]) <= 1
                        except ValueError:
                            ok = False
                        if not ok:
                            out.append(ConfigError("E030", f"{a} must be a share from 0 to 1"))
            if c.tag != "compute":
                visit(c)

    for c in env.children:
        if c.tag in ("sequence", "mix", "switch", "pool"):
            name = c.attrs.get("name", "")
            if not name:
                out.append(ConfigError("E013", f"a <{c.tag}> has no name"))
            elif name.startswith("_"):
                out.append(ConfigError("E014", f"names that begin with _ are reserved: {name}"))
            elif name in seen:
                out.append(ConfigError("E015", f"{name} is declared twice"))
            if c.tag == "sequence" and (p := c.attrs.get("parent")) and p.split(".")[0] not in seen:
                out.append(ConfigError("E016", f"the parent of {name} is not declared above it"))
            if c.tag == "switch" and c.attrs.get("on", "").split(".")[0] not in seen:
                out.append(ConfigError("E016", f"the subject of {name} is not declared above it"))
            seen.add(name)
    visit(root)
    return out
