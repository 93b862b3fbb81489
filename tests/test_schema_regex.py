"""Schemas and the patterns they compile to: random schemas against judges of values, and the texts of a few."""

import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework import errors
from latticework.functions import patterns as P
from latticework.plans.schema_regex import build_regex_from_schema, regex_from_str, regex_from_value

W = P.WHITESPACE

# Random schemas, each with a judge of its own that knows values instead of patterns. A schema is drawn with the values that it is likely to meet.

NAMES = ("id", "tag", "x-1", "größe")
TEXTS = st.text("ab é.{", max_size=4)
SCALARS = st.none() | st.booleans() | st.integers(-2000, 2000) | TEXTS
VALUES = st.recursive(SCALARS, lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.sampled_from(NAMES), inner, max_size=3), max_leaves=5)


def same(a, b):
    """Equal as JSON: true isn't 1, and members have an order."""
    return json.dumps(a) == json.dumps(b)


def within(n, low, high):
    return (low is None or n >= low) and (high is None or n <= high)


def ends(low, high):
    return st.tuples(st.none() | st.integers(0, 2), st.none() | st.integers(2, 4)).map(lambda e: {k: v for k, v in zip((low, high), e, strict=True) if v is not None})


@st.composite
def integers(draw):
    bounds = draw(ends("minDigits", "maxDigits"))
    low, high = bounds.get("minDigits") or None, bounds.get("maxDigits")
    return {"type": "integer"} | bounds, lambda v: type(v) is int and (v == 0 or within(len(str(abs(v))), low, high))


@st.composite
def strings(draw):
    bounds = draw(ends("minLength", "maxLength"))
    return {"type": "string"} | bounds, lambda v: type(v) is str and within(len(v), bounds.get("minLength"), bounds.get("maxLength"))


@st.composite
def constants(draw):
    values = draw(st.lists(VALUES, min_size=1, max_size=3))
    return ({"const": values[0]} if len(values) == 1 else {"enum": values}), lambda v: any(same(v, w) for w in values)


PLAIN = st.sampled_from([({"type": "boolean"}, lambda v: type(v) is bool), ({"type": "null"}, lambda v: v is None), ({"type": ["null", "boolean"]}, lambda v: v is None or type(v) is bool)])


@st.composite
def arrays(draw, inner):
    schema, fits = draw(inner)
    bounds = draw(ends("minItems", "maxItems"))
    return {"type": "array", "items": schema} | bounds, lambda v: type(v) is list and within(len(v), bounds.get("minItems"), bounds.get("maxItems")) and all(map(fits, v))


@st.composite
def tuples_(draw, inner):
    parts = draw(st.lists(inner, min_size=1, max_size=2))
    return {"prefixItems": [s for s, _ in parts]}, lambda v: type(v) is list and len(v) == len(parts) and all(f(x) for (_, f), x in zip(parts, v, strict=True))


@st.composite
def objects(draw, inner):
    """Members in the schema's order; those that aren't required may be missing, others may not be there."""
    members = dict(zip(NAMES, draw(st.lists(inner, min_size=1, max_size=3)), strict=False))
    required = draw(st.sets(st.sampled_from(list(members))))

    def fits(v):
        return type(v) is dict and list(v) == [n for n in members if n in v] and required <= v.keys() and all(members[n][1](x) for n, x in v.items())

    return {"type": "object", "properties": {n: s for n, (s, _) in members.items()}, "required": sorted(required)}, fits


@st.composite
def maps(draw, inner):
    schema, fits = draw(inner)
    least = draw(st.integers(0, 1))
    return {"type": "object", "additionalProperties": schema, "minProperties": least}, lambda v: type(v) is dict and len(v) >= least and all(map(fits, v.values()))


@st.composite
def unions(draw, inner):
    parts = draw(st.lists(inner, min_size=1, max_size=3))
    return {draw(st.sampled_from(["anyOf", "oneOf"])): [s for s, _ in parts]}, lambda v: any(f(v) for _, f in parts)


JUDGED = st.recursive(integers() | strings() | constants() | PLAIN, lambda inner: arrays(inner) | tuples_(inner) | objects(inner) | maps(inner) | unions(inner), max_leaves=4)


@settings(max_examples=400, deadline=None)
@given(JUDGED, st.lists(VALUES, min_size=1, max_size=12), st.booleans())
def test_patterns_match_what_schemas_allow(judged, values, referred):
    schema, fits = judged
    pattern = regex_from_value({"$defs": {"own": schema}, "$ref": "#/$defs/own"} if referred else schema)
    for v in values:
        for separators in ((",", ":"), (", ", ": ")):
            text = json.dumps(v, ensure_ascii=False, separators=separators)
            assert bool(re.fullmatch(pattern, text)) == bool(fits(v)), (schema, text)


@settings(max_examples=150, deadline=None)
@given(JUDGED, st.data())
def test_patterns_match_values_made_for_them(judged, data):
    """Values are made from the pattern; the judge has to allow each, spaces left out."""
    schema, fits = judged
    made = data.draw(st.from_regex(regex_from_value(schema, ""), fullmatch=True, alphabet=st.characters(min_codepoint=32, max_codepoint=0x17F, exclude_characters="\x7f" + "".join(map(chr, range(0x80, 0xA0))))))
    try:
        value = json.loads(made, object_pairs_hook=lambda pairs: dict(pairs) if len(dict(pairs)) == len(pairs) else None)
    except ValueError:
        return  # two names in one text, or a digit too many for a lone escape
    if json.dumps(value, ensure_ascii=False, separators=(",", ":")) == made:
        assert fits(value), (schema, made)


def test_sequences_of_schemas():
    """Every part of allOf follows the one before it."""
    pattern = regex_from_value({"allOf": [{"const": "h"}, {"type": "null"}, {"enum": [7, 8]}]})
    assert [bool(re.fullmatch(pattern, t)) for t in ('"h"null7', '"h"null8', '"h"null', "null7", '"h"null78')] == [True, True, False, False, False]


@pytest.mark.parametrize("whole, fraction, power", [((2, 4), None, None), (None, (1, 2), None), (None, None, (2, 3)), ((3, 3), (2, 2), (1, 1)), ((None, 2), (None, 3), None)])
def test_digits_of_numbers(whole, fraction, power):
    bounds = {f"{end}Digits{part}": n for part, pair in (("Integer", whole), ("Fraction", fraction), ("Exponent", power)) if pair for end, n in zip(("min", "max"), pair, strict=True) if n is not None}
    pattern = regex_from_value({"type": "number"} | bounds)
    if whole and whole[0] is None:
        whole = (2, whole[1])  # an upper bound alone asks for a second digit too
    fits = lambda n, pair: pair is None or within(n, *pair)
    for i in (1, 2, 3, 4, 5):
        for f in (0, 1, 2, 3, 4):
            for e in (0, 1, 2, 3, 4):
                text = "-" + "4" * i + ("." + "5" * f if f else "") + ("E-" + "6" * e if e else "")
                want = fits(i, whole) and (not f or fits(f, fraction)) and (not e or fits(e, power))
                assert bool(re.fullmatch(pattern, text)) == want, text
    assert all(re.fullmatch(pattern, t) for t in ("0", "-0")) and not re.fullmatch(pattern, "007")


def test_formats():
    import datetime
    import uuid

    rng = random.Random(6)
    form = {name: regex_from_value({"type": "string", "format": name}) for name in P.FORMATS}
    for _ in range(200):
        moment = datetime.datetime(rng.randint(1000, 9999), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59), rng.randint(0, 59))
        day, clock = f"{moment:%Y-%m-%d}", f"{moment:%H:%M:%S}"
        zone = rng.choice(["", "Z"])
        number = str(uuid.UUID(int=rng.getrandbits(128)))
        host = f"{rng.choice('abc')}{rng.randint(0, 99)}.example.net"
        for name, good, bad in (
            ("date", day, day.replace("-", ".")), ("date", day, day[:7]), ("time", clock + zone, clock[:5]), ("time", clock, "3" + clock[1:] if clock[0] != "3" else "39" + clock[2:]),
            ("date-time", f"{day}T{clock}{zone}", f"{day} {clock}"), ("date-time", f"{day}T{clock}.{rng.randint(100, 999)}", f"{day}T{clock}.1"), ("uuid", number, number[:-1]), ("uuid", number, number.replace("-", "_")),
            ("uri", f"https://{host}/p?q={rng.randint(0, 9)}#f", f"gopher://{host}"), ("uri", f"urn:lib:{number}", "urn:x"), ("email", f"u{rng.randint(0, 9)}.v@{host}", host), ("email", f"w@{host}", f"w@@{host}"),
        ):
            assert re.fullmatch(form[name], f'"{good}"') and not re.fullmatch(form[name], f'"{bad}"'), (name, good, bad)
            assert not re.fullmatch(form[name], good)


def test_spelled_patterns():
    """The exact text of a few, one for each kind of joint."""
    assert regex_from_value({"type": "string", "pattern": "^k[0-9]+$"}) == regex_from_value({"type": "string", "pattern": "k[0-9]+"}) == '("k[0-9]+")'
    assert regex_from_value({"const": "1+1 (é)#~"}) == r'"1\+1 \(é\)\#\~"'
    assert regex_from_value({"const": [3e17, 2e-5, 4e-9]}) == rf"\[{W}3e17{W},{W}0\.00002{W},{W}4e\-9{W}\]"
    assert regex_from_value({"type": "array", "items": {"type": "null"}, "minItems": 2, "maxItems": 6}) == rf"\[{W}((null)(,{W}(null)){{1,5}}){W}\]"
    assert regex_from_value({"properties": {}}) == r"\{()?[ ]?\}" and regex_from_value({"type": "object", "maxProperties": 0}) == rf"\{{{W}\}}"
    assert regex_from_value({"type": "string", "minLength": 2.5}) == f'"{P.STRING_INNER}{{0,}}"'


PART = {n: rf'[ ]?"{n}"[ ]?:[ ]?' + P.INTEGER for n in "abc"}


@pytest.mark.parametrize(
    "names, wanted, body",
    [
        ("abc", "abc", "{a}[ ]?,{b}[ ]?,{c}"),
        ("abc", "b", "({a}[ ]?,)?{b}([ ]?,{c})?"),
        ("abc", "a", "{a}([ ]?,{b})?([ ]?,{c})?"),
        ("abc", "cz", "({a}[ ]?,)?({b}[ ]?,)?{c}"),
        ("abc", "", "({a}|({a}[ ]?,)?{b}|({a}[ ]?,)?({b}[ ]?,)?{c})?"),
        ("ab", "z", "({a}|({a}[ ]?,)?{b})?"),
    ],
)
def test_commas_of_optional_properties(names, wanted, body):
    schema = {"type": "object", "properties": {n: {"type": "integer"} for n in names}, "required": list(wanted)}
    assert regex_from_value(schema) == r"\{" + body.format(**PART) + r"[ ]?\}"


def test_whitespace():
    schema = {"properties": {"a": {"type": "null"}}, "required": ["a"]}
    assert regex_from_value(schema, r"[\n ]*") == r'\{[\n ]*"a"[\n ]*:[\n ]*null[\n ]*\}'
    assert regex_from_value(schema, "") == r'\{"a":null\}'


def test_free_values_nest_to_their_depth():
    flat = regex_from_value({"type": "array", "depth": 0})
    assert flat == rf"\[{W}(({P.BOOLEAN}|null|{P.NUMBER}|{P.INTEGER}|{P.STRING})(,{W}({P.BOOLEAN}|null|{P.NUMBER}|{P.INTEGER}|{P.STRING})){{0,}})?{W}\]"
    whole = regex_from_value({"type": "object"})
    for text in ("{}", '{"a": 1, "b": null}', '{"a": {"z": {"g": 4}}, "b": [1, [true]]}'):
        assert re.fullmatch(whole, text), text
    assert not re.fullmatch(whole, '{"a": {"b": {"c": {"d": 1}}}}')
    anything = regex_from_value({})
    assert anything.startswith(f"({P.BOOLEAN})|(null)|({P.NUMBER})|({P.INTEGER})|({P.STRING})|(")
    assert len(anything) == 13_879
    assert re.fullmatch(anything, '{"a": [1, {"b": false}]}')


NODE = {"$ref": "#/definitions/node", "definitions": {"node": {"type": "object", "properties": {"v": {"type": "integer"}, "n": {"$ref": "#/definitions/node"}}, "required": ["v"]}}}


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_recursion_stops_at_its_limit(depth):
    pattern = regex_from_value(NODE, max_recursion_depth=depth)
    assert pattern.count('"v"') == depth + 1
    text = '{"v": 1}'
    for _ in range(depth):
        text = f'{{"v": 1, "n": {text}}}'
    assert re.fullmatch(pattern, text)
    assert not re.fullmatch(pattern, f'{{"v": 1, "n": {text}}}')


def test_references():
    root = {"$id": "urn:x", "$defs": {"s": {"type": "null"}}, "anyOf": [{"$ref": "#/$defs/s"}, {"$ref": "/$defs/s"}, {"$ref": "urn:x#/$defs/s"}]}
    assert regex_from_value(root) == "(null|null|null)"
    many = {"$id": "urn:x", "$defs": {"s": {"type": "null"}}, "anyOf": [{"$ref": "urn:x#/$defs/s"}] * 6}
    with pytest.raises(errors.RefRecursionLimitReached):
        regex_from_value(many)
    dropped = {"properties": {"a": {"$ref": "#"}, "b": {"type": "null"}}, "required": ["a", "b"]}
    assert regex_from_value(dropped, max_recursion_depth=0).count('"a"') == 1


@pytest.mark.parametrize(
    "schema, error",
    [
        ([], "UnsupportedJsonSchema"),
        ({"title": "x"}, "UnsupportedJsonSchema"),
        ({"type": "object", "additionalProperties": False}, "UnsupportedJsonSchema"),
        ({"properties": 1}, "PropertiesNotFound"),
        ({"allOf": {}}, "AllOfMustBeAnArray"),
        ({"anyOf": 1}, "AnyOfMustBeAnArray"),
        ({"oneOf": "x"}, "OneOfMustBeAnArray"),
        ({"prefixItems": None}, "PrefixItemsMustBeAnArray"),
        ({"enum": {}}, "EnumMustBeAnArray"),
        ({"$ref": 1}, "RefMustBeAString"),
        ({"$ref": "http://x#/a"}, "ExternalReferencesNotSupported"),
        ({"$ref": "a#b#c"}, "InvalidReferenceFormat"),
        ({"$ref": "#/nowhere"}, "InvalidReferencePath"),
        ({"type": 1}, "TypeMustBeAStringOrArray"),
        ({"type": [1]}, "TypeMustBeAStringOrArray"),
        ({"type": "float"}, "UnsupportedType"),
        ({"type": "string", "minLength": 3, "maxLength": 2}, "MaxBoundError"),
        ({"type": "integer", "minDigits": 5, "maxDigits": 2}, "MaxBoundError"),
        ({"type": "string", "format": "ipv4"}, "StringTypeUnsupportedFormat"),
    ],
)
def test_errors(schema, error):
    with pytest.raises(getattr(errors, error)):
        regex_from_value(schema)
    assert issubclass(getattr(errors, error), ValueError)


def test_json_text():
    with pytest.raises(TypeError, match="Expected a valid JSON string."):
        build_regex_from_schema("{'name':")
    with pytest.raises(errors.SchemaSyntaxError):
        regex_from_str("[1,")
    assert build_regex_from_schema('{"type": "null"}') == "null"


def test_escape():
    assert P.escape("a b.c") == r"a b\.c"
    for c in map(chr, range(32, 127)):
        assert re.fullmatch(P.escape(c), c)


@pytest.mark.parametrize("pattern, prefix", [(r"\{[ ]?a", "{"), ("abc", "abc"), ("ab?c", "a"), ("a|b", ""), ("(?:ab)c[de]", "abc"), ("[a]b", "ab"), ("(?i:a)b", ""), ("", ""), ("(?=x)", ""), ("ab{2}", "a")])
def test_literal_prefix(pattern, prefix):
    assert P.literal_prefix(pattern) == prefix


def test_fullmatch_pushes_its_prefix_to_the_reader(spark, tmp_path, capsys):
    frame = spark.createDataFrame([("key=1",), ("key=x",), ("no",), (None,), ("key=1\n",)], "v string")
    frame.write.parquet(str(tmp_path / "t"))
    found = spark.read.parquet(str(tmp_path / "t")).filter(P.fullmatch("v", "key=[0-9]+"))
    assert [r.v for r in found.collect()] == ["key=1"]
    found.explain("formatted")
    assert "StringStartsWith(v,key=)" in capsys.readouterr().out
