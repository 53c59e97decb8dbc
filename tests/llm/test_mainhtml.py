"""Main text: markup, zones, and repeated runs of a host."""

import html as entities
import re

import numpy as np

from rillmark.llm import mainhtml
from rillmark.llm.queries import op9_main_text


def main(html):
    return mainhtml.blocks(html)[0]


def test_zones():
    page = """<html><head><title>t</title></head><body class="has-sidebar"><div class="site-header">Logo</div><nav>n</nav>
      <main><header><h1>A &lt;title&gt;</h1></header><p>One <b>two</b>&nbsp;
      three<p class="notice">N<p>four<br>five<script>var a="</p>";</script><div id="comments"><article>c</article></div>
      <form>f</form><p hidden>h<p>x<span class="ad">y</span>z</main><aside>s</aside><footer>f</footer></body>"""
    assert main(page) == ["A <title>", "One two three", "four five", "x", "z"]
    assert main('<article class="comment">c</article><article>real<aside>no</aside> more</article>') == ["real", "more"]
    assert main("<ARTICLE><P>Upper &amp; l&eacute;&#233;&#x41;</P></ARTICLE>") == ["Upper & lééA"]


def test_cut_off_markup():
    assert main("<article><p>text &am") == ["text &am"]
    assert main("<article><p>a < 5 and b<p") == ["a < 5 and b"]
    assert main("<article>x<!-- open") == ["x"]
    assert main('<article>x<a href="a>b">y</a><style>p{') == ["xy"]
    assert main(None) == main("") == main("<<>>") == []


def test_unpaired_quotes_do_not_swallow_the_page():
    assert main("<article><p title=don't>B</p><p>C</p><p>D</p></article>") == ["B", "C", "D"]
    assert main('<article><img alt="5" screen"><p>B</p><a href="x">C</a><p>D</p></article>') == ["B", "C", "D"]
    assert main('<article><p title="open>B</p><p>C</p></article>') == ["B", "C"]
    assert main("""<article><p a = 'x>y' b=c"d e=="f>B</p><p ="g>C</p><p class=\n"ad">no</p></article>""") == ["B", "C"]


def test_ids_of_headings_and_sections_are_no_furniture():
    page = """<article><h2 id="related-work">Related</h2><section id="discussion"><p>d</p></section><p id="notice-period">n</p>
      <h3 id="social-history" class="related">s</h3><div id="discussion"><p>e</p></div><div id="comment-list"><p>f</p></div>
      <div id="comments">no</div></article><div id="related">no</div>"""
    assert main(page) == ["Related", "d", "n", "s", "e", "f"]
    assert mainhtml.blocks(page)[1] == [(False, "no"), (False, "no")]


def test_inline_raw_elements_do_not_cut_a_block():
    assert main("<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> here.</p></article>") == [
        "Energy is E=mc2 here."]
    assert main("<article><p>one<svg><text>x</text></svg>two <script>x</script>three<style>y</style></p></article>") == ["one two three"]
    assert main("<article><p>a <video>no player</video> <object>none</object></p></article>") == ["a no player none"]


def test_boxes():
    page = '<article>top<p>a</p><div class="x9">Buy</div><p>b</p><div class="entry"><p>c</p>tail<ul class="k"><li>d</li></ul></div></article>'
    box, prose = mainhtml.IN_BOX, mainhtml.IN_PROSE
    assert mainhtml.visible(page) == [(prose, "top"), (prose, "a"), (box, "Buy"), (prose, "b"), (prose, "c"), (box, "tail"), (prose, "d")]


def naive(pages, run, least):
    found = {}
    for number, tokens in enumerate(pages):
        for at in range(len(tokens) - run + 1):
            found.setdefault(tuple(tokens[at:at + run]), set()).add(number)
    out = []
    for tokens in pages:
        marks = [False] * len(tokens)
        for at in range(len(tokens) - run + 1):
            if len(found[tuple(tokens[at:at + run])]) >= least:
                marks[at:at + run] = [True] * run
        out.append(marks)
    return out


def test_repeated_runs():
    rng = np.random.default_rng(7)
    for run in (1, 2, 5, 8):
        pages = [[str(x) for x in rng.integers(0, 3, rng.integers(0, 40))] for _ in range(12)] + [[]]
        got = [marks.tolist() for marks in mainhtml.repeated(pages, run, 3)]
        assert got == naive(pages, run, 3)
    assert mainhtml.repeated([]) == []


def test_unmarked_pages_lose_what_the_host_repeats(spark):
    menu = "".join(f"<div>item{n} of the menu</div>" for n in range(5))
    rows = [(n, f"http://Host.example/{n}", f"<body>{menu}<p>own words of page {n} {n * 7} {n * 13} that no other page has</p></body>") for n in range(9)]
    rows += [(20, "http://other/1", f"<body>{menu}</body>"), (21, None, None), (21, None, ""), (None, "http://h/", "<article>kept</article>")]
    df = spark.createDataFrame([(*row, "x") for row in rows], "page_id long, url string, html string, text string")
    found = sorted(((row["page_id"] or 0, row["text"]) for row in mainhtml.main_text(df).collect()))
    want = [(n, f"own words of page {n} {n * 7} {n * 13} that no other page has") for n in range(9)]
    want += [(20, "\n".join(f"item{n} of the menu" for n in range(5))), (21, ""), (21, ""), (0, "kept")]
    assert found == sorted(want)
    assert mainhtml.main_text(df.limit(0)).count() == 0
    parsed = mainhtml.parse(df)
    split = {row["page_row"]: row["unique_text"] for row in mainhtml.unmarked(parsed, tokens=90).collect()}
    assert len(split) == len(rows) - 1


def texts(spark, rows, tokens=mainhtml.TOKENS):
    parsed = mainhtml.parse(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return {row["page_id"]: row["unique_text"] for row in mainhtml.unmarked(parsed, tokens).collect()}


ADVERT = "Buy the famous blue kettle now while our shops still have some left"


def words(n, count=12):
    return " ".join(f"w{n}x{at}" for at in range(count))


def test_adverts_in_marked_articles_go_and_shared_prose_stays(spark):
    rows = [(n, "http://h/", f'<article><p>{words(n)}</p><div class="x9">{ADVERT}</div><p>{ADVERT} as they say</p></article>') for n in range(40)]
    rows += [(50, "http://h/", f'<article><p>p</p><div class="x9">{words(50)}</div></article>')]
    found = texts(spark, rows)
    assert found == {**{n: f"{words(n)}\n{ADVERT} as they say" for n in range(40)}, 50: f"p\n{words(50)}"}


def test_the_host_size_and_the_cut_change_nothing(spark):
    rows = [(n, "http://h/", f"<div>{words(n)}</div>" + (f"<p>{ADVERT}</p>" if n % 17 == 0 else "")) for n in range(300)]
    rows += [(1000 + n, "http://small/", f"<div>{words(n)}</div><p>{ADVERT}</p>") for n in range(2)]
    want = {**{n: words(n) for n in range(300)}, **{1000 + n: f"{words(n)}\n{ADVERT}" for n in range(2)}}
    assert texts(spark, rows) == texts(spark, rows, 100) == texts(spark, rows, 20) == want


def test_copies_of_a_page_count_once(spark):
    rows = [(n, "http://h/", f"<div>{words(1)}</div><div>{words(2)}</div>") for n in range(30)]
    for tokens in (mainhtml.TOKENS, 10):
        assert texts(spark, rows, tokens) == {n: f"{words(1)}\n{words(2)}" for n in range(30)}


def test_random_hosts_like_a_plain_search(spark):
    rng = np.random.default_rng(11)
    rows = [(n, f"http://h{n % 3}/", "".join(f"<div>{' '.join(map(str, rng.integers(0, 2, rng.integers(4, 16))))}</div>" for _ in range(4)))
            for n in range(60)]
    want = {}
    for host in range(3):
        pages = {}
        for n, _, html in rows:
            if n % 3 == host:
                pages[n] = [block for _, block in mainhtml.blocks(html)[1]]
        # Random pages are distinct.
        marks = naive([" ".join(page).split() for page in pages.values()], mainhtml.RUN, mainhtml.PAGES)
        for (n, page), marked in zip(pages.items(), marks):
            kept, at = [], 0
            for block in page:
                end = at + len(block.split())
                if sum(marked[at:end]) < mainhtml.COVERED * (end - at):
                    kept.append(block)
                at = end
            want[n] = "\n".join(kept)
    assert texts(spark, rows) == texts(spark, rows, 200) == want
    assert 0 < sum(map(bool, want.values()))


def test_hosts(spark):
    urls = ["http://Host.example/a", " \u3000https://u:p@H:80\n", "http://b.c \x1f", "ftp+x://É.x?y", "//no", "no", "", None, "http://a\tb/c", "a://"]
    df = spark.createDataFrame([(n, url) for n, url in enumerate(urls)], "n long, url string")
    found = [row["host"] for row in df.select("n", mainhtml.host_of(df["url"]).alias("host")).orderBy("n").collect()]
    assert found == ["host.example", "h", "b.c", "é.x", "", "", "", "", "a\tb", ""]


NOTICE = "All rights are reserved by the famous kettle shop of our town"


def decided(spark, rows, tokens=mainhtml.TOKENS):
    parsed = mainhtml.parse(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return {row["page_id"]: row["text"] for row in mainhtml.decide(parsed, tokens).collect()}


def test_arrays_decide_the_prose_of_pages_without_boxes(spark):
    title = "The long title of one article that all menus of the host show"
    rows = [(n, "http://h/", f"<article><p>{words(n)}</p><p>{NOTICE}</p></article><nav>{title}</nav><footer>{NOTICE}</footer>") for n in range(9)]
    rows += [(20, "http://h/", f"<article><h1>{title}</h1><p>{words(20)}</p><p>{NOTICE} indeed</p></article><nav>{title}</nav><footer>{NOTICE}</footer>"),
             (21, "http://h/", f"<article><p>{words(21)}</p><p>{NOTICE}</p></article>")]
    want = {**{n: words(n) for n in range(9)}, 20: f"{title}\n{words(20)}\n{NOTICE} indeed", 21: f"{words(21)}\n{NOTICE}"}
    pages = spark.createDataFrame(rows + rows[:4], "page_id long, url string, html string")
    found = [(row["page_id"], row["text"]) for row in mainhtml.main_text(pages).collect()]
    assert sorted(found) == sorted([*want.items(), *((n, want[n]) for n in range(4))])
    assert decided(spark, rows) == decided(spark, rows, 40) == decided(spark, rows, 10) == want


def test_sentences_that_articles_and_adverts_share_stay(spark):
    rows = [(n, "http://h/", f'<div class="ad">{ADVERT if n % 3 else words(n + 99)}</div><article><p>{words(n)}</p>'
             f'<p>{ADVERT if n % 2 else words(n + 50)}</p></article>') for n in range(40)]
    assert decided(spark, rows) == decided(spark, rows, 50) == {n: f"{words(n)}\n{ADVERT if n % 2 else words(n + 50)}" for n in range(40)}


def test_random_prose_like_a_plain_search(spark):
    rng = np.random.default_rng(5)
    pool = [NOTICE, " ".join(NOTICE.split()[:9]), f"{NOTICE} {ADVERT}", ADVERT, " ".join(NOTICE.split()[2:])]

    def some(least, most):
        return [pool[min(at, 4)] if at < 5 or rng.random() < 0.2 else words(rng.integers(0, 40), 9)
                for at in rng.choice(8, rng.integers(least, most), p=[0.4, 0.1, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05]).tolist()]

    rows, want, lost = [], {}, 0
    for host in range(4):
        pages = {(host * 100 + n): (some(1, 4), some(1, 5)) for n in range(5 + 12 * host)}
        for n, (outside, prose) in pages.items():
            footers, article = "".join(f"<footer>{one}</footer>" for one in outside), "".join(f"<p>{one}</p>" for one in prose)
            rows.append((n, f"http://h{host}/", f"{footers}<article>{article}</article>"))

        def runs(text):
            tokens = text.split()
            return [tuple(tokens[at:at + mainhtml.RUN]) for at in range(len(tokens) - mainhtml.RUN + 1)]

        twice, distinct = {}, {(tuple(outside), tuple(prose)) for outside, prose in pages.values()}
        for outside, prose in distinct:
            own = set(runs(" ".join(outside)))
            for run in {run for one in prose if runs(one)[0] in own for run in runs(one)} & own:
                twice[run] = twice.get(run, 0) + 1
        for n, (outside, prose) in pages.items():
            own, kept = set(runs(" ".join(outside))), []
            for one in prose:
                marks = [False] * len(one.split())
                for at, run in enumerate(runs(one)):
                    if runs(one)[0] in own and run in own and twice.get(run, 0) >= mainhtml.PAGES and 2 * twice[run] > len(distinct):
                        marks[at:at + mainhtml.RUN] = [True] * mainhtml.RUN
                kept += [] if all(marks) else [one]
            want[n] = "\n".join(kept)
            lost += len(prose) - len(kept)
    assert decided(spark, rows) == decided(spark, rows, 150) == decided(spark, rows, 30) == want
    assert lost > 10


def test_query(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    found = {row["page_id"]: row for row in op9_main_text(spark, "/root/testdata/sf0.001").collect()}
    for page in pages:
        article = re.search(r"<article>(.*?)(</article>|\Z)", page["html"], re.DOTALL)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in re.split(r"</?(?:p|h1)>", article)]
        text = "\n".join(filter(None, blocks))
        assert found[page["page_id"]]["text"] == text and found[page["page_id"]]["n_chars"] == len(text)
