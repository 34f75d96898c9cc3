"""Page wrappers: inference, odd pages and blocks."""

import json
import random
import time

from plumbline.llm import html_wrappers as hw

FRAME = (
    "<html><head><title>t</title><script>var a='</p>';</script></head><body>"
    "<nav><ul>{menu}</ul></nav><div class='ad'>buy</div><article><h1>{title}</h1>{body}</article>"
    "<footer>foot</footer></body></html>"
)


def page(title, paragraphs, items=3):
    menu = "".join(f"<li><a href='x'>m{k}</a></li>" for k in range(items))
    return FRAME.format(menu=menu, title=title, body="".join(f"<p>{p}</p>" for p in paragraphs))


def text(sample, source):
    return hw.Extractor(json.dumps(hw.infer(sample))).text(source)


def test_wrapper_has_repeats_optionals_and_slots():
    sample = [page("A", ["one", "two"]), page("B", ["x"] * 5, 6).replace("</body></html>", "")]
    found = hw.infer(sample)
    assert found["root"] == "article"
    assert ("+", ("<p>", "#")) in found["items"] and ("+", ("<li>", "#")) in found["items"]
    assert ("?", ("</body>", "</html>")) in found["items"]


def test_text_of_the_article_alone():
    sample = [page("A", ["one", "two"]), page("B", ["x", "y", "z"])]
    source = page("T &amp; U", ["a<b>b</b>\n  c<br>d", "", "e &lt; f"])
    assert text(sample, source) == "T & U\n\nab c d\n\ne < f"


def test_odd_pages_are_aligned_first():
    sample = [page("A", ["one", "two"]), page("B", ["x", "y", "z"])]
    odd = page("T", ["a"]).replace("<p>a", "<table><tr><td>c1<td>c2</table><aside>s</aside><p>a")
    assert text(sample, odd) == "T\n\nc1\n\nc2\n\na"
    comments = page("T", ["a"]).replace("</article>", "<div id='comments'><p>no</p></div></article>")
    assert text(sample, comments) == "T\n\na"
    unclosed = "<article><p><b>one<br><p>two<form>"
    assert text(sample, unclosed) == "one\n\ntwo"
    assert text(sample, "no tags at all") == "no tags at all"
    assert text(sample, "") == ""


HEADED = "<body><header><p>Site</p></header><div>menu</div>{}<div>more</div></body>"


def test_a_list_in_place_of_the_paragraphs_matches():
    sample = [HEADED.format(f"<article><h1>T</h1>{'<p>x</p>' * n}</article>") for n in (2, 3)]
    odd = HEADED.format("<article><h1>T</h1><ul><li>a<li>b</ul><table><tr><td>c</table></article>")
    assert text(sample, odd) == "T\n\na\n\nb\n\nc"
    # Also where a group holds the site's header and the article's beginning.
    moved = odd.replace("<div>menu</div><article>", "<section>s</section><article class='wide'>")
    assert text(sample, moved) == "T\n\na\n\nb\n\nc"
    assert text([sample[0], odd, moved], sample[1]) == "T\n\nx\n\nx\n\nx"


def test_a_wrapper_covers_both_sides():
    chance = random.Random(3)
    tokens = ["<a>", "<b>", "<c>", "</b>", "#"]
    for _ in range(400):
        shapes = [chance.choices(tokens, k=chance.randint(1, 9)) for _ in range(4)]
        items = hw.folded(shapes[0])
        for shape in shapes[1:]:
            items = hw.aligned(items, hw.folded(shape))
        wrapper = hw.Wrapper(items, "", [])
        for shape in shapes:
            page = hw.Page("")
            page.shape = shape
            assert wrapper.match(page) is not None, (shapes, items)


def test_without_an_article_what_all_pages_share_goes():
    frame = "<body><div>Logo</div><div>{}</div><div class=sidebar>s</div><p>All rights</p></body>"
    sample = [frame.format(t) for t in ("one", "two", "three")]
    assert text(sample, frame.format("four")) == "four"


def test_what_all_pages_tell_stays_in_the_content():
    story = "The council met on Tuesday and agreed on the plan."
    frame = "<body><div>Logo</div><div><h1>{}</h1><p>Said twice</p></div><p>" + story + "</p></body>"
    for names in (("one", "two"), ("one", "two", "three")):
        sample = [frame.format(name) for name in names]
        assert text(sample, sample[0]) == "one\n\nSaid twice\n\n" + story
    assert text(sample[:1], sample[0]) == "Logo\n\none\n\nSaid twice\n\n" + story
    # Without the wrapper nothing is known of the template.
    assert hw.Extractor(None).text(sample[0]).startswith("Logo")


def free_form(chance, blocks):
    kinds = ("<p>w</p>", "<ul><li>a<li>b</ul>", "<h2>h</h2>", "<blockquote>q</blockquote>")
    body = "".join(chance.choice(kinds) for _ in range(blocks))
    return f"<body><div>menu</div><article><h1>t</h1>{body}</article><div>end</div></body>"


def test_articles_in_any_order_are_matched_at_once():
    chance = random.Random(5)
    known = hw.Extractor(json.dumps(hw.infer([free_form(chance, 40) for _ in range(6)])))
    for blocks in (40, 60, 300):
        source = free_form(chance, blocks)
        begun = time.process_time()
        hw.Wrapper(known.items, "article").match(hw.Page(source))
        assert time.process_time() - begun < 1
        begun = time.process_time()
        found = known.text(source).split("\n\n")
        assert time.process_time() - begun < 3
        assert found[0] == "t" and not {"menu", "end"} & set(found)
        assert len(found) == 1 + blocks + source.count("<ul>")


def test_a_page_beyond_every_automaton_is_read_whole():
    sample = [free_form(random.Random(k), 20) for k in range(3)]
    source = free_form(random.Random(9), 20_000)
    found = text(sample, source).split("\n\n")
    assert len(found) == 1 + 20_000 + source.count("<ul>") and found[0] == "t"


def slow_match(items, shape):
    """All ways through a wrapper, place by place, without any automaton."""

    def ends(parts, at):
        if not parts:
            return {at}
        part, rest = parts[0], parts[1:]
        if isinstance(part, str):
            here = {at} if part == hw.SLOT else set()
            if at < len(shape) and shape[at] == part:
                here.add(at + 1)
        else:
            here, new = set(), {at}
            while new:
                new = set().union(*(ends(part[1], k) for k in new)) - here
                here |= new
                if part[0] == "?":
                    break
            here |= {at} if part[0] == "?" else set()
        return set().union(*(ends(rest, k) for k in here))

    return len(shape) in ends(tuple(items), 0)


def test_automaton_against_all_ways():
    chance = random.Random(11)
    tokens = ["<a>", "<b>", "</b>", "#"]

    def items(depth):
        return tuple(
            (chance.choice("+?"), items(depth - 1)) if depth and chance.random() < 0.4
            else chance.choice(tokens)
            for _ in range(chance.randint(1, 3))
        )

    outcomes = set()
    for _ in range(3000):
        wrapper = items(2)
        shape = chance.choices(tokens, k=chance.randint(0, 6))
        places = hw.Automaton(list(wrapper)).match(shape)
        assert (places is not None) == slow_match(wrapper, shape), (wrapper, shape)
        outcomes.add(places is not None)
    assert outcomes == {True, False}


def slow_best(old, new):
    """The best score of an alignment, by every move from every pair of places."""
    best = {(len(old), len(new)): 0}
    for i in range(len(old), -1, -1):
        for j in range(len(new), -1, -1):
            ways = [s + best[i + t, j + p] for s, t, p, _ in hw._moves(old, new, i, j)]
            if ways:
                best[i, j] = max(ways)
    return best


def test_scores_of_rows_at_once():
    chance = random.Random(7)
    tokens = ["<a>", "<b>", "</b>", "#"]
    for _ in range(500):
        old, new = (hw.folded(chance.choices(tokens, k=chance.randint(0, 12))) for _ in "ab")
        old = hw.aligned(old, hw.folded(chance.choices(tokens, k=6)))
        scores = hw._scores(old, new)
        assert all(scores[at] == value for at, value in slow_best(old, new).items())


def test_blocks_are_counted_over_all_pages(spark):
    frame = "<body><div>Logo</div><div>{}</div><div>All rights</div></body>"
    # The last page of many says something else at the foot: nobody's sample need hold it.
    many = [(k, "http://a.example/", frame.format(f"t{k}")) for k in range(60)]
    many.append((99, "http://a.example/", frame.format("t99").replace("All rights", "None")))
    few = [(100 + k, "http://b.example/", frame.format(f"t{k % 2}")) for k in range(4)]
    pages = spark.createDataFrame(many + few, "page_id bigint, url string, html string")
    found = {r.page_id: r.text for r in hw.extract(pages).collect()}
    assert found[3] == "Logo\n\nt3\n\nAll rights" and found[99] == "Logo\n\nt99\n\nNone"
    assert found[100] == "t0" and found[103] == "t1"


def test_pages_table(spark):
    rows = [(k, f"http://h.example/{k}", page(f"T{k}", [f"p{k}", "q" * k])) for k in range(30)]
    rows += [(50, None, None), (51, "nonsense", "<p>x</p>"), (3, "http://h.example/3", None),
             (52, "http://big.example/", page("L", ["long " * 40_000]))]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {(r.page_id, r.text[:9], r.n_chars) for r in hw.extract(frame).collect()}
    assert len(found) == len(rows)
    assert (5, "T5\n\np5\n\nq", 13) in found and (50, "", 0) in found and (51, "x", 1) in found
    assert (52, "L\n\nlong l", 200_002) in found
    assert hw.extract(frame.limit(0)).count() == 0


def test_every_page_of_a_host_is_inferred_from(spark):
    """However many, long or odd: a shape that one page of many has is in the wrapper."""
    rows = [(k, "http://h.example/", page(f"T{k}", ["x"] * (k % 5 + 1))) for k in range(80)]
    odd = page("T", ["a"]).replace("<p>a", "<table><tr><td>c</table><dl><dt>d</dl><p>a")
    rows.append((80, "http://h.example/", odd))
    rows.append((81, "http://h.example/", page("L", ["long " * 40_000]).replace("<h1>", "<h2>")))
    many = "".join(random.Random(k).choice(("<p>w</p>", "<h3>h</h3>")) for k in range(1_200))
    rows.append((82, "http://h.example/", page("M", ["m"]).replace("<p>m", many + "<p>m")))
    rows.append((83, "http://h.example/", "<body><div>plain</div></body>"))
    rows.append((84, "http://long.example/", page("L", ["long " * 40_000])))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.host: json.loads(r.wrapper) for r in hw.wrappers(pages).collect()}
    assert found["long.example"]["items"] and found["h.example"]["root"] == "article"
    known = {host: hw.Extractor(json.dumps(wrapper)) for host, wrapper in found.items()}
    for _, url, source in rows:
        assert known[url.split("/")[2]].known.match(hw.Page(source)) is not None
    texts = {r.page_id: r.text for r in hw.extract(pages).collect()}
    assert texts[80] == "T\n\nc\n\nd\n\na" and texts[7] == "T7\n\nx\n\nx\n\nx"
    assert texts[83] == "plain" and texts[81].endswith("long") and texts[82].count("w") > 400
    assert texts[82].startswith("M\n\n") and texts[82].endswith("m")


def test_wrappers_cover_each_other_whatever_grows():
    chance = random.Random(13)
    tokens = ["<a>", "<b>", "<c>", "</b>", "#"]
    for most in (6, 12, 600):
        for _ in range(150):
            shapes = [chance.choices(tokens, k=chance.randint(1, 9)) for _ in range(6)]
            whole = hw.Inference()
            for own in (shapes[:3], shapes[3:]):
                part = hw.Inference()
                for shape in own:
                    part.add_shape(hw.folded(list(shape)))
                found = part.found()
                if most < 600:
                    found["items"] = hw.widened(found["items"])
                whole.add(json.loads(json.dumps(found)))
            if most == 6:
                whole.items = hw.widened(whole.items)
            wrapper = hw.Wrapper(whole.items, "")
            assert all(wrapper.automaton.match(shape) is not None for shape in shapes)


def test_names_that_each_page_makes_up_do_not_widen_a_wrapper():
    sources = [
        page(f"T{k}", ["a", "b"]).replace("<article>", f"<article id=post-{k}>").replace(
            "<footer>", f"<div id=end-{k}>more</div><footer>")
        for k in range(800)
    ]
    begun = time.process_time()
    found = hw.inferred(sources)
    assert time.process_time() - begun < 60
    assert hw.places_of(found["items"]) <= hw.WIDEST and found["root"] == "article"
    known = hw.Extractor(json.dumps(found))
    for source in (sources[3], sources[799], page("N", ["a", "b"])):
        assert known.text(source).split("\n\n")[1:] == ["a", "b"]
    new = sources[3].replace("post-3", "post-x").replace("end-3", "end-x")
    assert all(known.known.match(hw.Page(s)) is not None for s in (sources[3], sources[799], new))


def test_pages_without_an_article_beside_others():
    plain = "<body><div>Logo</div><div>{}</div><div>All rights</div></body>"
    mixed = [plain.format(t) for t in ("one", "two")]
    mixed.append("<body><div>Logo</div><article>three</article><div>All rights</div></body>")
    assert [text(mixed, source) for source in mixed] == ["one", "two", "three"]
