import numpy as np

from voxlake.llm.html_text import Labeller, blocks, fit, main_text, varied, vectors, weak_labels

WORDS = "alpha beta gamma delta über été nine lines of prose, and more.".split()


def page(i, rng):
    some = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    body = "".join(f"<p>{some(int(rng.integers(1, 40)))}</p>" for _ in range(int(rng.integers(1, 6))))
    return f"<html><head><title>{some(3)}</title><style>p{{}}</style><script>var t='<p>x</p>';</script></head><body><nav><ul><li><a href='/'>{some(1)}</a></li></ul></nav><div class=\"ad\">{some(6)}</div><article><h1>{some(4)}</h1>{body}</article><footer>&copy; {some(3)}</footer></body></html>"


def frame(spark, rows):
    return spark.createDataFrame([(i, "u", h, "clash") for i, h in rows], "page_id long, url string, html string, text string").repartition(2)


def truth(read):
    return "\n".join(b[1] for b, main in zip(read, weak_labels(read)) if main)


def test_blocks_decode_join_and_close():
    read = blocks("<p>a &amp;amp; b&nbsp;<b>c</b>\n d<p>second<br>line<div class='Side bar'>x<a href='>'>y</a></div>tail <!-- <p>no</p> --> 1 < 2 &lt;p&gt; &#233;<script>if(a<b)</script>")
    assert [b[1] for b in read] == ["a &amp; b c d", "second line", "xy", "tail 1 < 2 <p> é"]
    assert read[2][0] == ("div", ".side", ".bar") and read[2][2] == 0.5
    assert blocks("") == [] and blocks("<p> </p>") == [] and blocks("<p>open")[0][1] == "open"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = Labeller()
    model.w = {k: v.astype("float64") for k, v in model.w.items()}
    pages = [vectors(blocks(page(i, rng))) for i in range(3)]
    x, mask = (a.astype("float64") for a in Labeller.padded(pages))
    y = (rng.random(mask.shape[:2]) > 0.5).astype(float)
    _, grads = model.gradients(x, mask, y)
    for name in ("xf", "hb", "cf", "out", "hf"):
        flat, g = model.w[name].reshape(-1), grads[name].reshape(-1)
        k = int(np.argmax(np.abs(g)))
        old = flat[k]
        flat[k] = old + 1e-3
        up, _ = model.gradients(x, mask, y)
        flat[k] = old - 1e-3
        down, _ = model.gradients(x, mask, y)
        flat[k] = old
        assert abs((up - down) / 2e-3 - g[k]) < 1e-2 * abs(g[k]) + 1e-4


def test_held_out_pages_plain_and_varied(spark):
    rng = np.random.default_rng(1)
    pages = [(i, page(i, rng)) for i in range(120)]
    model = fit(frame(spark, pages[:80]))
    rest = pages[80:] + [(i + 1000, varied(h, rng)) for i, h in pages[80:]]
    got = {r["page_id"]: r["text"] for r in main_text(frame(spark, rest), model).collect()}
    assert all(got[i] == truth(blocks(h)) for i, h in pages[80:])
    assert sum(got[i] == truth(blocks(h)) for i, h in rest) >= 0.9 * len(rest)


def test_odd_pages(spark):
    rng = np.random.default_rng(2)
    model = fit(frame(spark, [(i, page(i, rng)) for i in range(60)]))
    long = "<article>" + "".join(f"<p>paragraph {i} of prose, and more.</p>" for i in range(6000)) + "</article>"
    rows = [(1, None), (2, ""), (3, "<div>"), (None, page(1, rng)), (4, long), (4, long)]
    out = main_text(frame(spark, rows), model).collect()
    assert sorted(str(r["page_id"]) for r in out) == ["1", "2", "3", "4", "4", "None"]
    assert {r["text"] for r in out if r["page_id"] in (1, 2, 3)} == {""}
    assert [r["text"].count("\n") for r in out if r["page_id"] == 4] == [5999, 5999]


def test_no_pages(spark):
    assert fit(frame(spark, [])) is None and main_text(frame(spark, []), None).collect() == []
    assert main_text(frame(spark, [(1, "<article><p>x</p></article>")]), None).collect()[0]["text"] == ""


def test_hidden_elements_without_an_end_hide_nothing_else():
    def texts(h):
        return [b[1] for b in blocks(h)]

    for x in ("<svg class='i'/>", "<svg/>", "<svg>", "<select name=a>", "<select-menu></select-menu>", "<template-card>", "<template>", "<noscript>", "<iframe-box>", "<script-x>", "<!-->", "<!--->", "<svg class=a><svg><text>no</text></svg>", "<script>no</script x>"):
        assert texts(f"<article><p>a</p>{x}<p>main text</p></article>") == ["a", "main text"], x
    for x in ("<svg><g/><svg><text>no</text></svg><text>no</text></svg>", "<select><option>no</select>", "<template><p>no</p></template >", "<NOSCRIPT><p>no</noscript>", "<!-- <svg> --!>", "<script>'<svg>'</script>", "<textarea><svg></textarea>"):
        assert texts(f"<p>a</p>{x}<p>main text</p>") == ["a", "main text"], x
    assert texts("<p>a</p><script>if(a<b)<p>no</p>") == ["a"]


def test_long_pages_are_learned_from(spark):
    rng = np.random.default_rng(5)
    pages = [(i, page(i, rng).replace("</article>", "".join(f"<p>{' '.join(rng.choice(WORDS, 6))}</p>" for _ in range(230)) + "</article>")) for i in range(10)]
    assert all(len(blocks(h)) > 200 for _, h in pages)
    model = fit(frame(spark, pages[:6]))
    got = {r["page_id"]: r["text"] for r in main_text(frame(spark, pages), model).collect()}
    assert all(got[i] == truth(blocks(h)) for i, h in pages)


def test_pages_without_a_main_element_teach_nothing(spark):
    rng = np.random.default_rng(6)
    unnamed = [(i, page(i, rng).replace("article>", "section>")) for i in range(60)]
    kept = {r["page_id"]: r["text"] for r in main_text(frame(spark, unnamed), fit(frame(spark, unnamed))).collect()}
    assert all(kept[i] == "\n".join(b[1] for b in blocks(h)) for i, h in unnamed)
    named = [(100 + i, page(i, rng)) for i in range(40)]
    alone, mixed = fit(frame(spark, named)), fit(frame(spark, named + unnamed), sample_pages=40)
    assert all(np.array_equal(alone.w[k], mixed.w[k]) for k in alone.w)
    assert weak_labels(blocks('<div class="body-text"><p>x</p></div><body class="text"><p>y</p>')).tolist() == [1, 0]
