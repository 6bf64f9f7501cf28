"""Main text of web pages: a suffix array over each host's token streams, with markup as evidence.

A page is cut into blocks, each with its slot (the path of elements and classes
that it stands in) and with what markup says of it: dropped (scripts, forms,
menus, headers, footers, sidebars, notices, adverts, comments), main (a marked
article) or plain.  The token streams of all pages of a host are laid end to end
and their suffixes sorted; neighbours with at least `run` tokens in common from
distinct pages are repeats, and tokens under them are covered.  Then

  - a slot most of whose distinct texts is covered is boilerplate, and all of
    its blocks go.  A slot of marked articles goes only if nearly all of it is
    covered while the articles' other slots are not: hosts whose articles are
    copies of each other keep them
  - what markup drops, goes; on a page that marks an article, so does what lies
    outside of it, unless the uncovered plain text outweighs the article by far
  - in plain blocks that stay, covered runs are removed and unique runs kept; a page that would lose all of its text that way keeps the blocks whole

A host is dealt to shards of bounded size, so that a large host is not one task.
Results are those of the whole host, however it is dealt (page_rounds.py): every run
of its shards is compared, and slots are judged by sums over the host.

Cases: a null html, or a page without text, has the text ''; pages with null
url form one host; equal rows count as one page; an unclosed article ends with
the page; very long pages are read whole; an empty table gives no rows; other
columns pass through, and a clash with a result column is resolved in favour of
the result.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.columns import untaken
from gleaner.llm.page_rounds import COVERED, DROPPED_MARK, MAIN, PLAIN, Rounds, Stream, answers_of, pack_page, suffix_order  # noqa: F401 (Stream and suffix_order: for callers)
from gleaner.llm.urls import host_of
from gleaner.session import bounded_batches, stored

PIECES = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|(?:svg|math)(?=\b[^>]*(?<!/)>))\b[^>]*>.*?(?:</\1\s*>|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements by how they are read.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup svg math time tt u var wbr br".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("nav footer aside form head title button select option dialog menu fieldset audio video canvas object".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
DROPPED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner\w*|nav|navbar|navigation|menu\w*|sidebar\w*|footer\w*|masthead|breadcrumb\w*|cookie\w*|consent|gdpr|notice\w*|notification\w*|alert|popup|modal|overlay"
    r"|newsletter\w*|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|comment\w*|disqus|discussion|repl(?:y|ies)|respond|widget\w*|search\w*|pagination|pager|toolbar|copyright|legal|disclaimer|skip)(?:$|[\s_-])",
    re.I,
)
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article[_-]?(?:body|content|text)?|post[_-]?(?:body|content)|entry[_-]?content|main[_-]?content|story[_-]?body)(?:$|\s)", re.I)
RESULT = ("text", "n_repeated")
#: A table of at most this many rows may be broadcast.
BROADCAST_ROWS = 60_000
#: A host has at most so many shards; they are larger from there on.
MOST_SHARDS = 1024


@dataclass(frozen=True)
class PagePlan:
    #: Least length of a repeated token run.
    run: int = 8
    #: Share of a plain block's characters in links from which it goes.
    links: float = 0.5
    #: Covered share from which a slot is boilerplate; the same for slots of marked articles; pages that it must stand on.
    slot: float = 0.6
    main_slot: float = 0.95
    slot_pages: int = 5
    #: Without effect, kept for callers: shards of one host compare every run.
    far_sample: int = 1
    #: Bytes of html in a shard, about.  Decides the size of tasks, not results.
    shard_bytes: int = 2_000_000


@dataclass
class Block:
    text: str
    mark: int
    slot: str


def blocks_of(source: str, plan: PagePlan = PagePlan()) -> list[Block]:
    """Blocks in page order with what markup says of each."""
    stack: list[tuple[str, bool, bool, str]] = []  # element, drops, is main, element with its classes
    dropping = mains = linked = 0
    texts: list[str] = []
    found: list[Block] = []
    link_chars = 0

    def end_block() -> None:
        nonlocal link_chars
        if texts:
            block = " ".join(html.unescape("".join(texts)).split())
            if block:
                linked_most = link_chars > plan.links * sum(map(len, texts))
                mark = DROPPED_MARK if dropping else MAIN if mains else DROPPED_MARK if linked_most else PLAIN
                found.append(Block(block, mark, "/".join(k for k, _ in groupby(x[3] for x in stack if x[3]))))
            texts.clear()
        link_chars = 0

    def close(upto: int) -> None:
        nonlocal dropping, mains, linked
        while len(stack) > upto:
            name, drops, main, _ = stack.pop()
            dropping -= drops
            mains -= main
            linked -= name == "a"

    at = 0
    for m in PIECES.finditer(source):
        if m.start() > at:
            texts.append(source[at : m.start()])
            if linked:
                link_chars += m.start() - at
        at = m.end()
        name = m[3]
        if name is None:
            if m[1]:
                texts.append(" ")
            continue
        name = name.lower()
        if name not in INLINE:
            end_block()
        elif name == "br":
            texts.append(" ")
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        if name in VOID or m[4].endswith("/"):
            continue
        attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(m[4])} if m[4] else {}
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
        main = name in ("article", "main") or attributes.get("role", "").lower() == "main" or attributes.get("itemprop") == "articleBody" or bool(names and name not in INLINE and MAIN_NAMES.search(names))
        drops = name in DROPPED or (name == "header" and not mains) or "hidden" in attributes or attributes.get("role", "").lower() in DROPPED_ROLES
        if name == "article" and any(x[0] == "article" for x in stack):  # a comment on the article around it
            main = main and not (attributes.get("itemprop", "").lower() == "comment" or bool(DROPPED_NAMES.search(names) and not MAIN_NAMES.search(names)))
            drops = drops or not main
        drops = drops or bool(names and not main and name not in ("html", "body") and DROPPED_NAMES.search(names))
        if name in ("article", "main", "body") and dropping and not any(s[0] in ("article", "main") for s in stack):
            close(next(k for k, s in enumerate(stack) if s[1]))  # left open by mistake
        if name in ("p", "li") and stack and stack[-1][0] == name:
            close(len(stack) - 1)
        stack.append((name, drops, main, "" if name in INLINE else f"{name}.{names}" if names else name))
        dropping += drops
        mains += main
        linked += name == "a"
    if at < len(source):
        texts.append(source[at:])
    end_block()
    return found


def long_stretches(covered: np.ndarray, least: int) -> np.ndarray:
    """Covered words in stretches of at least so many, or all where the whole block is covered: a run
    that ends a few words into the next block takes nothing from it."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    keep = np.zeros(len(covered), bool)
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        keep[a:b] = b - a >= min(least, len(covered))
    return keep


def main_text(blocks: list[str], marks: np.ndarray, gone: np.ndarray, covered: list[np.ndarray], run: int) -> str:
    """The text of one page from what markup and the host's repeats say of its blocks."""
    size = np.array([len(c) for c in covered])
    fresh = size - np.array([int(c.sum()) for c in covered], int) if len(size) else size
    plain, main = (marks == PLAIN) & ~gone, (marks == MAIN) & ~gone
    is_marked = bool((marks == MAIN).any()) and not fresh[plain].sum() > max(50, 2 * size[main].sum())
    cut = not is_marked and fresh[plain].sum() > 0.05 * size[plain].sum()
    out = []
    for k, block in enumerate(blocks):
        if main[k]:
            out.append(block)
        elif plain[k] and not is_marked:
            if cut and covered[k].any():
                block = " ".join(w for w, c in zip(re.findall(r"[^ \t-\r]+", block), long_stretches(covered[k], run), strict=True) if not c)
            if block:
                out.append(block)
    return "\n".join(out)


def with_shards(rows: DataFrame, host: str, page: str, plan: PagePlan) -> tuple[DataFrame, str, str]:
    """rows with the number of shards of their host, and the shard: for the size of tasks only, no result depends on it."""
    shards, shard = untaken(rows.columns, "shards"), untaken(rows.columns, "shard")
    size = F.sum(F.coalesce(F.octet_length("html"), F.lit(0)))
    fits = F.greatest(F.lit(plan.shard_bytes), F.ceil(size / MOST_SHARDS))
    large = rows.groupBy(host).agg(F.ceil(size / fits).cast("int").alias(shards)).where(F.col(shards) > 1)
    large = stored(large, "hosts")
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    dealt = rows.join(large, host, "left").withColumn(shards, F.coalesce(shards, F.lit(1)))
    return dealt.withColumn(shard, F.pmod(page, F.col(shards)).cast("int")), shards, shard


def extract_main_text(pages: DataFrame, plan: PagePlan = PagePlan()) -> DataFrame:
    """pages with `text`, the main text of each page's whole html, and `n_repeated`, its tokens that the host repeats."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(pages.sparkSession)
    pages = pages.drop(*RESULT)
    rest = [f for f in pages.schema.fields if f.name != "html"]
    host, page, packed, size = (untaken(pages.columns, n) for n in ("host", "page", "packed", "size"))
    rows = pages.withColumn(host, F.coalesce(host_of(F.col("url")), F.lit(""))).withColumn(page, F.xxhash64("url", "html"))
    rows, shards, shard = with_shards(rows, host, page, plan)
    keep = [*[f.name for f in rest], host, page, shards, shard]
    parsed_schema = T.StructType([*[rows.schema[n] for n in keep], T.StructField(packed, T.BinaryType()), T.StructField(size, T.LongType())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        for b in batches:
            made = []
            for x in b.column("html"):
                own = blocks_of(x.as_py() or "", plan)
                for o in own:
                    if o.slot not in known:
                        known[o.slot] = hashlib.blake2b(o.slot.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                made.append(pack_page([o.text for o in own], bytes(o.mark for o in own), b"".join(known[o.slot] for o in own)))
            cols = [b.column(n) for n in keep] + [pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, parsed_schema.names)

    parsed = rows.mapInArrow(parse, parsed_schema)
    out_schema = T.StructType([*rest, T.StructField("text", T.StringType()), T.StructField("n_repeated", T.LongType())])
    out_arrow = to_arrow_schema(out_schema)
    rounds = Rounds(plan.run, plan.shard_bytes, page, packed, size, shards)

    def finish(t: pa.Table, back: pa.Table) -> pa.Table:
        own = rounds.read(t)
        edges = np.concatenate(([0], np.cumsum(own.counts())))
        bits = next(a for k, a in zip(back.column("kind").to_pylist(), back.column("a").to_pylist(), strict=True) if k == COVERED)
        covered = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(edges[-1])) > 0
        total = np.concatenate(([0], np.cumsum(covered)))
        gone = np.isin(own.slots, np.array([s for s in back.column("slot").to_pylist() if s is not None], np.int64)) | (own.marks == DROPPED_MARK)
        texts, repeated, k = [], [], 0
        for o in own.blocks:
            to = k + len(o)
            texts.append(main_text(o, own.marks[k:to], gone[k:to], [covered[edges[i] : edges[i + 1]] for i in range(k, to)], plan.run))
            repeated.append(int(total[edges[to]] - total[edges[k]]))
            k = to
        t = t.take(pa.array(own.order))
        extra = {"text": pa.array(texts, pa.string()), "n_repeated": pa.array(repeated, pa.int64())}
        return pa.Table.from_arrays([(extra[f.name] if f.name in extra else t.column(f.name)).cast(f.type) for f in out_arrow], schema=out_arrow)

    answers = answers_of(parsed, host, shard, rounds, (plan.slot, plan.main_slot, plan.slot_pages))
    return parsed.groupBy(host, shard).cogroup(answers.groupBy("host", "at")).applyInArrow(finish, out_schema)
