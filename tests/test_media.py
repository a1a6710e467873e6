import io
import tarfile

import pytest

from webstrata.functions.media import assigned_json, dash_segments

BASE = "https://m.example/v/m.mpd"


def wrap(inner, rep='<Representation id="a" bandwidth="1"/>'):
    return f'<MPD mediaPresentationDuration="PT5S"><Period><AdaptationSet>{inner}{rep}</AdaptationSet></Period></MPD>'


def test_dash_timeline_list_and_base():
    timeline = '<SegmentTemplate media="$Time$.m4s" timescale="1"><SegmentTimeline><S t="0" d="2" r="1"/><S d="3"/></SegmentTimeline></SegmentTemplate>'
    assert [u for _, u in dash_segments(wrap(timeline), BASE)] == [f"https://m.example/v/{t}.m4s" for t in (0, 2, 4)]
    listed = '<Representation id="a" bandwidth="1"><BaseURL>x/</BaseURL><SegmentList><Initialization sourceURL="i.mp4"/><SegmentURL media="1.m4s"/></SegmentList></Representation>'
    assert [u for _, u in dash_segments(wrap("", listed), BASE)] == ["https://m.example/v/x/i.mp4", "https://m.example/v/x/1.m4s"]
    assert list(dash_segments("<MPD>", BASE)) == []


def urls_of(manifest):
    return [u.removeprefix("https://m.example/v/") for _, u in dash_segments(manifest, BASE)]


def test_dash_takes_every_representation_and_period():
    reps = '<Representation id="a" bandwidth="1"/><Representation id="b" bandwidth="high"><BaseURL>b/</BaseURL></Representation>'
    inner = '<AdaptationSet><SegmentTemplate media="$RepresentationID$$Number%03d$$$.m4s" duration="2"/>' + reps + "</AdaptationSet>"
    two = f'<MPD mediaPresentationDuration="PT8S"><Period duration="PT4S">{inner}</Period><Period duration="PT4S"><BaseURL>https://q.example/</BaseURL>{inner}</Period></MPD>'
    own = ["a001$.m4s", "a002$.m4s", "b/b001$.m4s", "b/b002$.m4s"]
    assert urls_of(two) == [*own, *["https://q.example/" + x for x in own]]
    assert urls_of(two.replace(' duration="PT4S"', "")) == [*[f"{x}00{i}$.m4s" for x in ("a", "b/b") for i in (1, 2, 3, 4)], *[f"https://q.example/{x}00{i}$.m4s" for x in ("a", "b/b") for i in (1, 2, 3, 4)]]
    alone = '<MPD><Period><AdaptationSet><BaseURL>s/</BaseURL><Representation id="a"><BaseURL> v.mp4?a=1&amp;b </BaseURL></Representation><Representation id="b"/></AdaptationSet></Period></MPD>'
    assert urls_of(alone) == ["s/v.mp4?a=1&b"]


def test_dash_templates_add_to_those_above():
    m = '<x:MPD mediaPresentationDuration="PT3S"><x:Period><SegmentTemplate timescale="10" startNumber="7"/><x:AdaptationSet><SegmentTemplate media="$Bandwidth$/$Number$" duration="10"/><Representation bandwidth="5"><SegmentTemplate media="own-$Number$"/></Representation><Representation bandwidth="6"/></x:AdaptationSet></x:Period></x:MPD>'
    assert urls_of(m) == ["own-7", "own-8", "own-9", "6/7", "6/8", "6/9"]


@pytest.mark.parametrize("number", ["0", "", "x", "nan", "inf", "-3", "1e999"])
def test_dash_with_numbers_that_cannot_be_read(number):
    for name in ("duration", "timescale", "startNumber"):
        attributes = {"duration": "2", "timescale": "1", "startNumber": "1"} | {name: number}
        got = urls_of(wrap("<SegmentTemplate media='$Number$' " + " ".join(f"{k}='{v}'" for k, v in attributes.items()) + "/>", '<Representation id="a" bandwidth="high"/>'))
        assert len(got) in (0, 3)
    for s in (f'<S d="{number}"/>', f'<S t="{number}" d="2"/>', f'<S d="2" r="{number}"/>'):
        assert len(urls_of(wrap(f'<SegmentTemplate media="$Time$"><SegmentTimeline>{s}</SegmentTimeline></SegmentTemplate>'))) == 1


def test_dash_of_broken_and_large_texts():
    for text in ("", "<", "<MPD", "<MPD><Period><AdaptationSet><Representation>", "</MPD>", "<MPD><!-- " * 50_000, "<MPD>" + "<a b='" * 50_000, "<" + "a" * 200_000, "<!MPD>", "<MPD><Period></AdaptationSet></Period>"):
        assert urls_of(text) == []
    many = wrap('<SegmentTemplate media="$Number$" duration="1" timescale="100000"/>')
    assert len(list(dash_segments(many, BASE, most=1000))) == 1000


def test_assigned_json():
    assert assigned_json("var ytData = {'a': '}' , b: \"x", "ytData") is None and assigned_json("ytData = {'a\\'}': {}} ;", "ytData") == "{'a\\'}': {}}"
    assert assigned_json("ytData = {" + '"a' * 100_000, "ytData") is None
    assert assigned_json('window["ytData"] = {"a": "}\\"{", "b": {}};', "ytData") == '{"a": "}\\"{", "b": {}}'
    assert assigned_json("var ytData = {open", "ytData") is None and assigned_json("", "x") is None


def tar(names):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for n in names:
            info = tarfile.TarInfo(n)
            info.size = 2
            t.addfile(info, io.BytesIO(b"hi"))
    return out.getvalue()


def test_html_tokens():
    from webstrata.functions.html import html_tokens

    opened = lambda html: [(n, a) for kind, n, a, _ in html_tokens(html) if kind == "open"]
    assert opened("""<a HREF = "x>y" title='<b>' data-q=1/2 disabled href=z>t</a>""") == [("a", {"href": "x>y", "title": "<b>", "data-q": "1/2", "disabled": ""})]
    assert opened("<!-- <i> --><!doctype html><?x <u>?><br/><p") == [("br", {})]
    assert list(html_tokens("<SCRIPT src=a>if (a<b) '<img>'</scripts></Script x>z<p>")) == [("open", "script", {"src": "a"}, None), ("raw", "script", None, "if (a<b) '<img>'</scripts>"), ("close", "script", None, None), ("open", "p", {}, None)]
    assert opened("""<img alt="a" src='b.png"' x>""") == [("img", {"alt": "a", "src": 'b.png"', "x": ""})]
    assert opened("<style>a{}") == [("style", {})] and list(html_tokens("")) == [] and opened("a < b > c") == []
    for text in ("<" * 100_000, "<a " * 50_000, '<a b="' * 50_000, "<!--" * 50_000, "<a " + "x" * 500_000, "<script>" * 30_000, "<a ='" * 50_000 + ">"):
        assert len(list(html_tokens(text))) < 3
