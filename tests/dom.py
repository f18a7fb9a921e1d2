"""Brute-force page reader for tests: the standard library's HTML parser and an explicit tree."""

from html.parser import HTMLParser

VOID = set(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta "
    "nextid param source spacer track wbr".split()
)


class Page(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = {"name": "", "attrs": {}, "children": []}
        self.path = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = {"name": tag, "attrs": {k: v or "" for k, v in attrs}, "children": []}
        self.path[-1]["children"].append(node)
        if tag not in VOID:
            self.path.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.path.pop()

    def handle_endtag(self, tag):
        if any(node["name"] == tag for node in self.path[1:]):
            while self.path.pop()["name"] != tag:
                pass

    def handle_data(self, data):
        children = self.path[-1]["children"]
        if children and isinstance(children[-1], str):
            children[-1] += data
        else:
            children.append(data)

    def all(self, *names, node=None):
        for child in (node or self.root)["children"]:
            if isinstance(child, dict):
                if child["name"] in names:
                    yield child
                yield from self.all(*names, node=child)


def hrefs(html):
    return {t["attrs"]["href"] for t in Page(html).all("a", "link", "area") if "href" in t["attrs"]}


def script_sources(html):
    return {t["attrs"]["src"] for t in Page(html).all("script") if "src" in t["attrs"]}


def inline(html):
    found = [t for t in Page(html).all("script") if "src" not in t["attrs"]]
    return ["".join(t["children"]) for t in found if t["children"]]


def field(node):
    attrs, kind = node["attrs"], node["name"]
    if kind == "input":
        kind = attrs["type"] if "type" in attrs else "text"
    return attrs.get("name", ""), kind


def forms(html):
    page, found = Page(html), []
    for node in page.all("form"):
        attrs = {"action": "", "method": "get", **node["attrs"]}
        fields = [field(inner) for inner in page.all("input", "textarea", "select", node=node)]
        found.append((attrs["action"], attrs["method"].upper(), fields))
    return found
