"""Queries that SQL can't express, against plain versions in memory."""

import re

import pytest

from lexweave.plans import queries as Q

from .conftest import SF


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name):
    return Q.QUERIES[name](spark, SF).collect()


def loops(text):
    text = re.sub(r"(.{5,50}?)\1{9,}", r"\1", text)
    text = re.sub(r"([一-龥]{2,10})\1{9,}", r"\1", text)
    text = re.sub(r"(?i)\b(\w{3,})\s+(?:\1\s+){9,}", r"\1 ", text)
    return re.sub(r"([。，！？；：])\1{3,}", r"\1\1\1", text)


def cleaned(text):
    for pattern in (r"（注：[^）]*）", r"\(注：[^)]*\)", r"【修正后的译文】[:：]?\s*", r"\[修正后的译文\][:：]?\s*", r"(?i)^Here is the translation[:：]?\s*", r"(?i)^Translation[:：]?\s*", r"^```markdown\s*", r"\s*```$"):
        text = re.sub(pattern, "", text)
    return loops(text).strip()


def repeats(text):
    return re.search(r"(.{5,30}?)\1{4,}", text) is not None


def missed_terms(original, translation):
    found = sorted((t for t in Q.TERMS if t[1].lower() in original.lower()), key=lambda t: (-len(t[1]), t[0]))[:25]
    return [t for t in found if t[2] not in translation and not (t[2].split(" (")[0].strip() and t[2].split(" (")[0].strip() in translation)]


def found_issues(original, translation):
    """Severities of what is wrong, and whether it asks for a repair."""
    out, repair = [], False
    if re.search(r"[A-Za-z]+(?:\s+[A-Za-z]+){11,}", translation):
        out, repair = [3], True
    n = len(missed_terms(original, translation))
    out, repair = out + [2] * n, repair or n > 0
    for pattern, weight in ((r"(?m)^#{1,6}\s+", 2), (r"!\[[^\]]*\]\([^)]+\)", 3), (r"\[[^\]]+\]\([^)]+\)", 2), ("```", 3)):
        if len(re.findall(pattern, original)) != len(re.findall(pattern, translation)):
            out, repair = [*out, weight], True
    return out + [1] * repeats(translation), repair


def translated(text):
    """(translation, repaired, passed) by the stub, with one repair."""
    first = cleaned(f"译文：{text}")
    issues, repair = found_issues(text, first)
    if not repair:
        return first, False, not issues
    again, _ = found_issues(text, "修复后的译文")
    return ("修复后的译文", True, not again) if sum(again) <= sum(issues) else (first, False, False)


def plan(text, limit=3600, shortest=1296):
    """(section path, chunk) of a text, written out step by step."""
    blocks, path, held, fence = [], [], [], False
    for line in [*text.splitlines(), None]:
        mark = line is not None and line.strip().startswith("```")
        head = None if line is None or fence or mark else re.match(r"(#{1,6})\s+(.*)$", line)
        if line is None or head or (mark and not fence) or (not fence and not line.strip()):
            if held:
                blocks.append(("\n".join(held), list(path), False))
            held = []
        if head:
            path = path[: len(head[1]) - 1] + [head[2].strip()]
            blocks.append((line, list(path), True))
        elif line is not None and (mark or fence or line.strip()):
            held.append(line)
            if mark and fence:
                blocks.append(("\n".join(held), list(path), False))
                held = []
            fence = fence != mark
    chunks, now, where = [], [], None
    for raw, section, head in blocks:
        block = raw.strip()
        if now and (head or section != where or len("\n\n".join([*now, block])) > limit):
            chunks.append([where, "\n\n".join(now)])
            now, where = [], None
        where = section if where is None else where
        if len(block) <= limit:
            now.append(block)
            continue
        pieces = [block]
        for cut in ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", " "):
            new = []
            for piece in pieces:
                if len(piece) <= limit or cut not in piece:
                    new.append(piece)
                    continue
                current = ""
                for part in piece.split(cut):
                    more = (current + cut + part if current else part).strip()
                    if current and len(more) > limit:
                        new.append(current.strip())
                        current = part
                    else:
                        current = more
                new += [current.strip()] if current.strip() else []
            pieces = new
        chunks += [[section, p[i : i + limit]] for p in pieces for i in range(0, len(p), limit)]
    if now:
        chunks.append([where, "\n\n".join(now)])
    out = []
    for section, chunk in chunks:
        if out and out[-1][0] == section and len(out[-1][1]) < shortest and len(out[-1][1]) + 2 + len(chunk) <= limit:
            out[-1][1] += "\n\n" + chunk
        else:
            out.append([section, chunk])
    if len(out) > 1 and out[-1][0] == out[-2][0] and len(out[-1][1]) < shortest and len(out[-2][1]) + 2 + len(out[-1][1]) <= limit:
        out[-2][1] += "\n\n" + out.pop()[1]
    return out


def test_repetition(spark, texts):
    assert sorted(r.doc_id for r in rows(spark, "repetition_flags")) == sorted(i for i, t in texts.items() if repeats(t))


def test_loops(spark, texts):
    import hashlib

    tail = "循环" * 12 + "the same phrase " * 20 + "结束。。。。。。"
    assert {r.doc_id: r.cleaned for r in rows(spark, "collapse_loops")} == {i: hashlib.sha256(cleaned(t + tail).encode()).hexdigest() for i, t in texts.items()}


def test_plans_of_books(spark):
    from collections import defaultdict

    want = defaultdict(lambda: [0, 0])
    for r in Q.books(spark, SF).collect():
        for section, chunk in plan(r.text):
            own = want[r.book, section[-1] if section else "Document Root"]
            own[0], own[1] = own[0] + 1, max(own[1], len(chunk))
    assert {(r.book, r.section_title): [r.chunks, r.longest] for r in rows(spark, "book_chunks")} == dict(want) and len(want) > 10


def test_repairs(spark, texts):
    from collections import Counter

    want = Counter((True, repaired, passed) for _, repaired, passed in map(translated, texts.values()))
    assert {(r.success, r.repaired, r.passed): r.chunks for r in rows(spark, "repair_loop")} == dict(want) and len(want) > 1


def test_whole_documents(spark, texts):
    import hashlib

    want = {}
    for i, t in texts.items():
        parts = ["\n\n" + "\n".join(f"> {x}" for x in c.split("\n")) + f"\n\n{translated(c)[0]}\n\n---\n\n" for _, c in plan(t)]
        want[i] = hashlib.sha256((f"# {i} - 中文翻译（双语对照）\n\n> 由 AI 自动翻译\n\n" + "".join(parts)).encode()).hexdigest()
    assert {r.doc: r.sha256 for r in rows(spark, "translated_documents")} == want


def test_limiter(spark):
    calls = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "event_id", "unix_micros(cast(ts as timestamp)) / 1e6 as at").collect():
        calls.setdefault(r.user_id, []).append((r.at, r.event_id))
    for r in rows(spark, "limiter_simulation"):
        level, clock, waited = 2.0, None, 0.0
        for at, _ in sorted(calls[r.key]):
            now = at if clock is None else max(at, clock)
            level = min(2.0, level + (0 if clock is None else (now - clock) * 2 / 3600))
            pause = 0.0 if level >= 1 else (1 - level) * 3600 / 2
            level = 0.0 if pause else level - 1
            clock, waited = now + pause, waited + now - at + pause
        assert r.calls == len(calls[r.key]) and r.waited == pytest.approx(waited, abs=0.01)


def test_consistency(spark):
    from lexweave.operators.evaluation import STOPWORDS

    segments = sorted((r.seg, r.source, r.translation) for r in Q.segments(spark, SF).collect())
    where = {}
    for seg, source, _ in segments:
        for sentence in re.split(r"[.!?;:\n]+", source):
            w = [x.lower() for x in re.findall(r"[A-Za-z][A-Za-z'\-]*", sentence)]
            for n in (2, 3, 4):
                for g in zip(*(w[i:] for i in range(n)), strict=False):
                    if g[0] not in STOPWORDS and g[-1] not in STOPWORDS:
                        where.setdefault(" ".join(g), set()).add(seg)
    named = [t[1].lower() for t in Q.TERMS]
    kept = {p: s for p, s in where.items() if len(s) >= 2 and not any(p in t or t in p for t in named)}
    kept = {p: s for p, s in kept.items() if not any(q != p and p in q and s == z for q, z in kept.items())}
    told = {seg: t for seg, _, t in segments}

    def common(a, b):
        best = ""
        for i in range(len(a)):
            while i + len(best) < len(a) and a[i : i + len(best) + 1] in b:
                best = a[i : i + len(best) + 1]
        return best

    good = 0
    for p in kept:
        shared = None
        for seg in sorted(kept[p]):
            shared = told[seg] if shared is None else common(shared, told[seg]) if len(shared) >= 2 else ""
        shared = shared.strip()
        good += len(shared) >= 2 and re.search("[一-鿿]", shared) is not None
    (got,) = rows(spark, "consistency_summary")
    assert (got.total, got.consistent) == (len(kept), good) and got.rate == pytest.approx(round(good / max(1, len(kept)), 4))


def test_formatted_pages(spark):
    import hashlib

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()}
    for r in rows(spark, "format_markdown"):
        i = r.page_id
        body = "\n".join(x.rstrip() for x in re.sub(r"(?s)<!--.*?-->", "", pages[i]).split("\n"))
        want = f"## Chapter\n\n> Quoted {i}\n\n```python\nx  = 1\n```\n\n## 目录\n\n- [S](#s)\n\n![p.1](images/p.1.png)\n\n## Part {i}\n\n> text {i}\n\na *b* c\n\n![a.{i}](images/a.{i}.png)\n\n1) First NICK LAND\n\n{body}"
        assert r.formatted == hashlib.sha256((want.strip() + "\n").encode()).hexdigest()
