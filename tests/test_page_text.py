"""Page text: entities, unclosed scripts, crossing blocks."""

import pytest

from sensorloom.operators import search as SE

CASES = [
    ("<title>Caf&eacute; &amp;amp; Bar</title><body>x</body>", "Café &amp; Bar", "x"),
    ("<body>It&#8217;s &#xe9;t&#xE9; &nope; A&B &amp;#233;</body>", "", "It’s été &nope; A&B &#233;"),
    ("<body>a<script>var t = 1; <p>b</p></body>", "", "a"),
    ("<body>a<nav><ul><li>n</li></ul></nav>b<footer>f</footer></body>", "", "a b"),
    ("<body>a&nbsp;&#160;b &#0;&#xD800;</body>", "", "a b ��"),
    ("&lt;b&gt; no tags &copy;", "", "<b> no tags ©"),
    ("", "", ""),
    ("<body>a<nav>b<nav>c</nav>d</nav>e</body>", "", "a e"),
    ("<body>a<div class='ad'>b<div>c</div>d</div>e<div class=ad>f</div><div class='bad'>g</div></body>", "", "a e g"),
    ("<body><p title=\"x>y\">a</p><p title='</nav>'>b</p></body>", "", "a\nb"),
    ("<body>a<nav>never closed<p>b</p></body>", "", "a never closed b"),
    ("<body>a</nav>b<form>c<nav>d</form>e</nav>f < g</body>", "", "a b e f < g"),
    ("<body>a<script>x='</nav>'; y < z</script>b<!-- <nav> -->c<style>p > a {}</style></body>", "", "a b c"),
    ("<body>" + "<p>x</p>" * 3000 + "<nav>n</nav>" * 300 + "</body>", "", "x\n" * 2999 + "x"),
    ("<p " + "a='b' " * 5000 + ">t</p>" + "<" * 2000, "", "t\n" + "<" * 2000),
    (None, None, None),
]


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([(i, "u", h) for i, (h, _, _) in enumerate(CASES)], "page_id long, url string, html string")
    return {r.page_id: r for r in SE.page_text(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_page_text(got, i):
    assert (got[i].title, got[i].content) == CASES[i][1:]
    assert got[i].likely_script_rendered == (None if CASES[i][2] is None else CASES[i][2] == "")
