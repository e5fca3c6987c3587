"""Oracle SQL fragments: the same input frames, written in DuckDB SQL."""

PX = (
    "px AS (SELECT vec_id AS frame, (p - 1) // 8 AS y, (p - 1) % 8 AS x,"
    " CAST(floor((CAST(embedding[p] AS DOUBLE) + 1) * 8191.5) AS BIGINT) AS val"
    " FROM embeddings, (SELECT unnest(range(1, 65)) AS p) r)"
)
RGB = PX + (
    ", rgb AS (SELECT frame, y // 2 AS y, x // 2 AS x,"
    " CAST(4 * max(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN val END) AS BIGINT) AS r,"
    " CAST(4 * (CAST(sum(CASE WHEN (y + x) % 2 = 1 THEN val END) AS BIGINT) // 2) AS BIGINT) AS g,"
    " CAST(4 * max(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN val END) AS BIGINT) AS b FROM px GROUP BY 1, 2, 3)"
)
DENSE = PX + ", d AS (SELECT frame, list(val ORDER BY y, x) AS a FROM px GROUP BY frame), pd AS (SELECT px.*, a FROM px JOIN d USING (frame))"
INDEX = "idx AS (SELECT event_id AS frame, epoch_us(ts) AS t_us, event_type AS kind, user_id AS clip, value AS size, ts FROM events)"


def with_px(body: str) -> str:
    return f"WITH {PX} {body}"


def with_rgb(body: str) -> str:
    return f"WITH {RGB} {body}"


def with_dense(body: str) -> str:
    return f"WITH {DENSE} {body}"


def with_index(body: str) -> str:
    return f"WITH {INDEX} {body}"


def at(dy: int, dx: int, a: str = "a") -> str:
    """A neighbour with replicated edges, as SQL on ``pd``."""
    return f"{a}[least(greatest(y + {dy}, 0), 7) * 8 + least(greatest(x + {dx}, 0), 7) + 1]"


def at_zero(dy: int, dx: int, a: str = "a") -> str:
    return f"(CASE WHEN y + {dy} BETWEEN 0 AND 7 AND x + {dx} BETWEEN 0 AND 7 THEN {a}[(y + {dy}) * 8 + x + {dx} + 1] ELSE 0 END)"


def trunc(e: str) -> str:
    return f"CAST(trunc({e}) AS BIGINT)"


def clamp(e: str, low="0", high="65535") -> str:
    return f"greatest(least({e}, {high}), {low})"


def r6(e: str) -> str:
    """Rounded to six decimals, and no negative zero."""
    return f"(round({e}, 6) + 0.0)"
