"""Vectors: a deterministic pseudo-embedding of a line, unit length, cosine."""

from __future__ import annotations

from credsieve.functions.text import let

# Fixed value: length of an embedding.
DIMENSION = 384


def character_sums(text: str) -> str:
    """Struct (a, b): code points times cos and sin of their byte offset, summed.

    Component i of the raw embedding is sin(sum of c*sin(i + offset)), and
    sin(i + o) = sin i * cos o + cos i * sin o, so two sums over the text serve all
    384 components.
    """
    return (
        f"aggregate(split({text}, ''), named_struct('o', 0, 'a', 0D, 'b', 0D), (s, ch) ->"
        " named_struct('o', s.o + octet_length(ch),"
        " 'a', s.a + ascii(ch) * cos(s.o), 'b', s.b + ascii(ch) * sin(s.o)),"
        " s -> struct(s.a as a, s.b as b))"
    )


def raw_embedding(text: str) -> str:
    component = "cast(sin(sin(i) * s.a + cos(i) * s.b) as float)"
    vector = f"transform(sequence(0, {DIMENSION - 1}), i -> {component})"
    return let("s", character_sums(text), vector)


def unit(vector: str) -> str:
    """The vector over its length, in single precision; a zero vector stays as it is."""
    squares = "aggregate(v, cast(0 as float), (sum, x) -> cast(sum + x * x as float))"
    scaled = "if(n = 0, v, transform(v, x -> cast(x / n as float)))"
    return let("v", vector, let("n", f"cast(sqrt(cast({squares} as double)) as float)", scaled))


def embedding(text: str) -> str:
    return unit(raw_embedding(text))


def dot(a: str, b: str) -> str:
    """Dot product in double precision."""
    return (
        f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)),"
        " 0D, (sum, p) -> sum + p)"
    )


def norm(vector: str) -> str:
    return f"sqrt({dot(vector, vector)})"


def cosine(a: str, b: str) -> str:
    """Cosine similarity; 0 for unequal lengths, empty or zero vectors."""
    scaled = let("n", f"{norm(a)} * {norm(b)}", f"if(n = 0, 0D, {dot(a, b)} / n)")
    return f"cast(if(size({a}) <> size({b}) or size({a}) = 0, 0D, {scaled}) as float)"


def strict_cosine(a: str, b: str) -> str:
    """Cosine with every sum in single precision; vectors of unequal length are an error."""

    def summed(x: str, y: str) -> str:
        return (
            f"aggregate(zip_with({x}, {y}, (x, y) -> cast(cast(x as float) * cast(y as float) as float)),"
            " cast(0 as float), (sum, p) -> cast(sum + p as float))"
        )

    length = f"(sqrt(cast({summed(a, a)} as double)) * sqrt(cast({summed(b, b)} as double)))"
    scaled = let("n", length, f"if(n = 0, 0D, cast({summed(a, b)} as double) / n)")
    unequal = "raise_error('vectors must have same length')"
    return f"cast(if(size({a}) <> size({b}), cast({unequal} as double), {scaled}) as float)"
