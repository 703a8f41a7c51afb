from quaestor.operators.discover import discovered_questions

MENU = "<div class=top><a href=/>Home</a><a href=/a>About</a><a href=/c>Contact</a><a href=/d>Data</a></div>"
WORDS = "qual das normas a seguir trata do tema da prova de ontem segundo a lei".split()


def statement(k):
    return f"Questão {k}: " + " ".join(WORDS[k % 5:]) + "?"


def options(k):
    return [f"resposta {k}{letter}" for letter in "abcde"[: 3 + k % 3]]


def layout_cards(ks):
    """Records as cards with lettered options in paragraphs."""
    cards = [f"<li class='card c{0}'><span>{k}</span><div><p class=t>{statement(k)}</p>" + "".join(
        f"<p class=o>({'ABCDE'[i]}) {o}</p>" for i, o in enumerate(options(k))) + "</div></li>" for k in ks]
    return f"<body>{MENU}<main><ul>{''.join(cards)}</ul></main><footer><p>x</p><p>y</p><p>z</p></footer></body>"


def layout_flat(ks):
    """Records as runs of siblings without letters; end tags left out."""
    runs = [f"<h3>Item {k}</h3><blockquote>{statement(k)}</blockquote><ol>" + "".join(f"<li>{o}" for o in options(k)) + "</ol>" for k in ks]
    return f"<html>{MENU}<section>{'<hr>'.join(runs)}</section>"


def layout_table(ks):
    rows = [f"<tr><td class=n>{k}<td class=q>{statement(k)}<td><i>{'</i><i>'.join(options(k))}</i></tr>".replace("<td class=q>", "</td><td class=q>").replace("<td><i>", "</td><td><i>") for k in ks]
    return f"<div>{MENU}<table>{''.join(rows)}</table></div>"


def test_planted_records_of_layouts_without_a_name(spark):
    layouts, pages, want = [layout_cards, layout_flat, layout_table], [], {}
    for page in range(12):
        ks = list(range(10 * page, 10 * page + 3 + page % 6))
        pages.append((page, layouts[page % 3](ks)))
        for pos, k in enumerate(ks):
            want[page, pos] = (statement(k), {"ABCDE"[i]: o for i, o in enumerate(options(k))})
    pages += [(100, None), (101, ""), (102, "<p>one</p>"), (103, MENU)]
    df = spark.createDataFrame(pages, "page_id long, html string").repartition(4)
    got = {(r["page_id"], r["pos"]): (r["enunciado"], r["alternativas"]) for r in discovered_questions(df).collect() if r["page_id"] < 100}
    assert got == want
    assert discovered_questions(df.filter("page_id in (100, 101, 102)")).count() == 0
    assert discovered_questions(df.limit(0)).count() == 0


def test_records_that_differ_a_little(spark):
    """One record has a picture, another lacks its options; the list is still one."""
    html = layout_flat(range(8)).replace("<h3>Item 3</h3>", "<h3>Item 3</h3><img src=a><em>nota</em>").replace("<h3>Item 5</h3>", "<h3>Item <b>5</b></h3>")
    rows = discovered_questions(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("pos").collect()
    assert [r["enunciado"] for r in rows] == [statement(k) for k in range(8)]
    assert all(list(r["alternativas"].values()) == options(k) for k, r in enumerate(rows))


def test_options_and_menus_are_no_records(spark):
    """Pages of one or two questions repeat nothing but their options, menu and footer."""
    layouts = [layout_cards, layout_flat, layout_table]
    pages = [(3 * n + k, layout(range(n))) for n in (1, 2) for k, layout in enumerate(layouts)] + [(103, MENU)]
    assert discovered_questions(spark.createDataFrame(pages, "page_id long, html string")).collect() == []
