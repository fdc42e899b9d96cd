import json
import struct

from folio.sources import scene as S

DOC = {
    "asset": {"generator": " Tool 1 ", "copyright": "A Studio", "extras": "made by hand for the spring show"},
    "scenes": [{"name": "Scene"}],
    "nodes": [{"name": "Chair_Oak_Backrest"}, {"name": "HeroTitleFurniture", "extras": {"b": "a second sentence here", "a": ["a first sentence here", "id-0123456789"]}}, {"name": "Cube.001"}],
    "meshes": [{"name": "chair-oak-backrest"}, {"name": "HTMLParser"}],
    "materials": [{"name": "Material.042"}, {"name": "7"}],
}


def glb(doc) -> bytes:
    raw = json.dumps(doc).encode()
    raw += b" " * (-len(raw) % 4)
    junk = struct.pack("<I4s", 3, b"BIN\0") + b"xyz\0"
    body = junk + struct.pack("<I4s", len(raw), b"JSON") + raw
    return b"glTF" + struct.pack("<II", 2, 12 + len(body)) + body


def test_names():
    said = {"Chair_Oak_Backrest": "Chair Oak Backrest", "HeroTitle2Furniture": "Hero Title2 Furniture", "HTMLParser": "HTML Parser", "Object_017": "", "Cube Sphere": "", "ab": "", "": "", "x" * 121: "", "a_1_!_Lamp": "a Lamp"}
    assert {k: S.clean_name(k) for k in said} == said


def test_sentences():
    assert S.sentence(" some words stand here ") == "some words stand here"
    assert not any(map(S.sentence, ["short", "nospacesatallinthis", "see http://x.example now", "a <b> in the text", "1 2 3 4 5 6 7 8", "word " * 200]))


def test_scenes_of_both_forms(spark):
    plain = json.dumps(DOC).encode()
    bad = [b"", None, b"glTF", b"PNG....", b"{broken", b'{"nodes": 3}', b'{"nodes": [{"name": 3}]}', b'{"asset": []}x', glb(DOC)[:40]]
    rows = [(1, "a.gltf", plain), (2, "b.glb", glb(DOC)), (3, None, b'{"nodes": []}'), *((9, str(k), x) for k, x in enumerate(bad))]
    out = {r.page_id: r for r in S.scenes(spark.createDataFrame(rows, "page_id long, url string, body binary")).collect()}
    assert set(out) == {1, 2, 3}
    for k in (1, 2):
        assert out[k].names == ["Chair Oak Backrest", "Hero Title Furniture", "HTML Parser"] and (out[k].n_nodes, out[k].n_meshes) == (3, 2)
        assert out[k].texts == ["a first sentence here", "a second sentence here", "made by hand for the spring show"]
        assert out[k].text == "3D scene contains: Chair Oak Backrest, Hero Title Furniture, HTML Parser. a first sentence here. a second sentence here. made by hand for the spring show. Credited to A Studio"
    assert out[3].text == "" and out[3].names == []
