"""Differencing sees every page; the article only checks what it deleted."""

from netloom.llm import html


def test_every_page_is_compared_with_its_neighbour(spark):
    page = "<body><div>frame</div><article><p>quoted</p><p>own {}</p></article><div>end</div></body>"
    rows = [(n, f"http://h/a/{n}", page.format(n)) for n in range(3)]
    # the element's name stands in a comment or a script only, or it is empty: nothing says what is frame
    rows += [(10, "http://i/1", "<body><!-- <article> --><p>top</p><p>x</p>"), (11, "http://i/2", "<body><script>'<main>'</script><p>top</p><p>y</p>"),
             (12, "http://i/3", "<body><article></article><p>top</p><p>z</p>"), (13, None, "<p>alone</p>"), (14, "http://j/", None)]
    got = {r["page_id"]: (r["text"], r["n_shared"], r["n_restored"]) for r in html.extract(
        spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {0: ("quoted own 0", 3, 1), 1: ("quoted own 1", 3, 1), 2: ("quoted own 2", 3, 1),
                   10: ("x", 1, 0), 11: ("y", 1, 0), 12: ("z", 1, 0), 13: ("alone", 0, 0), 14: ("", 0, 0)}


def test_own_blocks_around_an_article_stay(spark):
    page = "<body><div>site</div><h1>title {0}</h1><article><p>quoted</p><p>own {0}</p></article><p>note {0}</p><div>site end</div></body>"
    rows = [(n, f"http://h/a/{n}", page.format(n)) for n in range(3)]
    # nothing in common with the neighbour, a copy at the next URL only, alone on its host, without a URL
    rows += [(10, "http://i/1", "<p>before</p><main>m</main>"), (11, "http://i/2", "<p>other</p>"),
             (12, "http://j/1", page.format(12)), (13, "http://j/2", page.format(12)),
             (14, "http://k/1", page.format(14)), (15, None, page.format(15))]
    got = {r["page_id"]: (r["text"], r["n_shared"], r["n_restored"]) for r in html.extract(
        spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    assert got == {n: (f"title {n} quoted own {n} note {n}", 3, 1) for n in range(3)} | {
        10: ("before m", 0, 0), 11: ("other", 0, 0)} | {
        n: (f"quoted own {k}", 0, 0) for n, k in ((12, 12), (13, 12), (14, 14), (15, 15))}
    assert html.main_text(rows[0][2], rows[1][2]) == got[0][0] and html.main_text(rows[7][2]) == got[14][0]
