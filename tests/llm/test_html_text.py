import data
import pytest

from quaestor.llm.html_text import extract_text, main_text

LONG = "The house of the family stood by the river and it was old, but they had lived in it for as long as anyone could remember, so it was theirs. "
CASES = [
    ("<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>" + LONG + "<p>Short.</article><footer>&copy; x</footer>", "Title\n" + LONG.strip() + "\nShort."),
    ("<article><p>a &amp;lt; b&nbsp; c<br>d</p><p>e<br><br>f</p></article>", "a &lt; b c d\ne\nf"),
    ("<article><div class='ad'>Buy now</div><p>x</p><aside>y</aside><div class='comments'><p>" + LONG + "</p></div></article>", "x"),
    ("<article><p>one<script>var t='</p>';</script> two</p><style>p{}</style><!-- no --></article>", "one two"),
    ("<article><form><p>Name</p><input></form><p>kept</p><div id='cookie-notice'>We use cookies</div></article>", "kept"),
    ("<article><p>THERE!! ARE!! " + "NOSTOPS!! " * 30 + "</p><p>b", "THERE!! ARE!! " + ("NOSTOPS!! " * 30).strip() + "\nb"),
    ("<div><p>" + LONG * 2 + "</p><p>Yes.</p><p>" + LONG * 2 + "</p></div><ul><li><a href=a>More links here</a><li><a href=b>And more</a></ul><div>Contact us</div>",
     (LONG * 2).strip() + "\nYes.\n" + (LONG * 2).strip()),
    ("<article><p>cut off at an entity &am", "cut off at an entity &am"),
    ("<article><p>cut off in a tag <a href='x", "cut off in a tag"),
    ("<p class='ad'>Ad text<p>" + LONG * 2, (LONG * 2).strip()),
    ("<main><section><h2>Part</h2><ul><li>item one<li>item two</ul></section></main>", "Part\nitem one\nitem two"),
    ("<html><head><title>T</title><body><main><p>no end of head</main>", "no end of head"),
    ("<article><p>a<span/>b</p><svg/><p>c", "ab\nc"),
    ("", ""), (None, ""), ("plain", ""),
]


@pytest.mark.parametrize("html,text", CASES)
def test_pages(html, text):
    assert main_text(html) == text


def test_broken_markup_never_raises():
    import random

    rng = random.Random(1)
    pieces = ["<p>", "</p>", "<b>", "</article>", "<article>", "<", ">", "&", "&#x110000;", "&#0;", "<!--", "-->", "<![CDATA[", "<?x", "text ", "<a href='", "\"", "<script>", "</script>", "<br>", "<!doctype"]
    for _ in range(2000):
        assert isinstance(main_text("".join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))), str)


def test_tables(spark):
    pages = data.with_clashes(spark.createDataFrame([(1, "u", CASES[0][0]), (1, "u", CASES[0][0]), (2, None, None), (None, "v", "")], "page_id long, url string, html string"))
    rows = extract_text(pages).collect()
    assert sorted(r["n_chars"] for r in rows) == sorted([len(CASES[0][1])] * 2 + [0, 0]) and all(len(r["text"]) == r["n_chars"] for r in rows)
    assert extract_text(data.empty(pages)).count() == 0
    assert extract_text(pages, keep_html=True).columns[2] == "html"


def test_table_pages_keep_their_articles(spark, sf_dir):
    import html as h
    import re

    for r in extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep_html=True).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        inner = re.sub(r"<[a-zA-Z/][^<>]*\Z", "", inner)
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b)


POLISH = "Rodzina mieszkała w starym domu nad rzeką, którego okna wychodziły na las, gdzie wieczorami słychać było śpiew ptaków. "
RUSSIAN = "Семья жила в старом доме у реки, окна которого выходили на лес, откуда вечерами доносилось пение птиц. "
JAPANESE = "その家族は川のほとりの古い家に住んでいて、窓からは森が見え、夕方になると鳥の声が聞こえてきた。"
MENU = "<ul><li><a href=/a>Start</a><li><a href=/b>Kontakt</a></ul>"


@pytest.mark.parametrize("text", [POLISH, RUSSIAN, JAPANESE])
def test_unlisted_language_without_article(text):
    """Paragraphs of any length by length and links alone; lists of links and furniture go."""
    links = "<p>" + "".join(f"<a href={k}>{text[:30]}</a> " for k in range(5)) + "</p>"
    page = f"<body><nav>{text * 3}</nav>{MENU}<div><h1>A1</h1><p>{text}</p><p>{text * 3}</p></div>{links}<div class='cookie'>{text * 2}</div><footer>{text}</footer>"
    assert main_text(page) == "\n".join(["A1", text.strip(), (text * 3).strip()])


def test_blocks_without_stop_words_among_others():
    """Code and names on a page of a listed language stay with the text around them."""
    code = "def f(x): return [y * 2 for y in range(x) if y % 3]; print(f(10), f(20), f(30), sep=';')"
    names = ", ".join(["Anna Kowalska", "Jan Nowak", "Piotr Zielinski", "Maria Lewandowska", "Adam Wojcik"])
    page = f"<body>{MENU}<p>{LONG * 2}</p><pre>{code}</pre><p>{LONG * 2}</p><p>{names}</p><p>{LONG * 2}</p>{MENU}"
    assert main_text(page) == "\n".join([(LONG * 2).strip(), code, (LONG * 2).strip(), names, (LONG * 2).strip()])

PAGE = "<h1>An old house</h1><p>" + LONG * 2 + "</p><p>And so it stayed.</p><p>" + LONG * 3 + "</p>"
PAGE_TEXT = "An old house\n" + (LONG * 2).strip() + "\nAnd so it stayed.\n" + (LONG * 3).strip()
MENU = "<ul><li><a href=a>Home</a><li><a href=b>News</a></ul>"


@pytest.mark.parametrize("before,after", [
    ("<form id='aspnetForm'>", "</form>"), ("<div class='elementor-widget'>", "</div>"), ("<div class='page has-sidebar'>", "</div>"),
    ("<article><div class='row has-sidebar'>", "</div></article>"), ("<div class='layout-with-sidebar no-footer'>", "</div>"),
    ("<div class='widget'><form><fieldset>", "</fieldset></form></div>"), ("<div class='widget'><article>", "</article></div>"),
    ("<main><form id=f>", "</form></main>"), ("<article><div class='section-header'></div>", "</article>"),
])
def test_names_of_frames_do_not_empty_a_page(before, after):
    assert main_text("<body><nav>" + MENU + "</nav>" + before + PAGE + after + "<footer>&copy; us</footer>") == PAGE_TEXT


def test_weak_names_beside_the_text_still_count():
    promo = "<div class='promo'><p>" + LONG + "</p></div><form><p>" + LONG + "</p></form><div class='widget'><p>" + LONG + "</p></div>"
    assert main_text("<article>" + PAGE + "</article>" + promo * 5) == PAGE_TEXT
    assert main_text("<div>" + PAGE + PAGE + "</div>" + promo) == PAGE_TEXT + "\n" + PAGE_TEXT
    assert main_text("<article><div class='section-header'><h2>Part</h2></div><p>" + LONG + "</p></article>") == "Part\n" + LONG.strip()
    assert main_text("<div class='comments'><p>" + LONG * 4 + "</p></div>") == ""


def test_labels_equal_the_rules_one_block_at_a_time():
    """Both passes against the rules written out for one block and its neighbours."""
    import random

    from quaestor.llm import html_text as t

    rng = random.Random(3)
    texts = ["Yes.", LONG.strip(), (LONG * 2).strip(), "code() " * 20, "Anna Berta Carla " * 6]

    def decided_near(blocks, labels, i, step):
        zone = blocks[i].zone
        j = i + step
        while 0 <= j < len(blocks):
            if blocks[j].zone == zone and labels[j] != t.OPEN and not (zone and blocks[j].furniture):
                return abs(i - j), labels[j]
            j += step
        return len(blocks), t.OPEN

    for _ in range(300):
        blocks = []
        for _ in range(rng.randint(1, 9)):
            text = rng.choice(texts).strip()
            linked = rng.choice([0, 0, 0, len(text)])
            blocks.append(t.Block(text, linked, rng.choice([0, 0, 1]), rng.random() < 0.2, rng.random() < 0.2))
        labels = t.first_labels(blocks)
        for block, label in zip(blocks, labels):
            if block.furniture:
                assert label == t.BAD
            elif block.linked and not block.zone:
                assert label == t.BAD
            elif block.zone and not block.linked:
                assert label == (t.GOOD if t.extent(block.text) >= t.SHORT else t.OPEN)
        second = t.second_labels(blocks, labels)
        for i, block in enumerate(blocks):
            if labels[i] != t.OPEN:
                assert second[i] == labels[i]
                continue
            (near, left), (far, right) = decided_near(blocks, labels, i, -1), decided_near(blocks, labels, i, 1)
            known = [x for x in (left, right) if x != t.OPEN]
            if len(known) == 2 and left == right or len(known) == 1:
                want = known[0]
            elif not known:
                want = t.GOOD if block.zone or t.extent(block.text) >= t.SHORT else t.BAD
            elif block.zone:
                want = t.GOOD
            elif block.heading:
                want = right
            elif near == far:
                want = t.GOOD if t.extent(block.text) >= t.SHORT else t.BAD
            else:
                want = left if near < far else right
            assert second[i] == want
