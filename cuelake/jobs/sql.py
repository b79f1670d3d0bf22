"""Pieces of SQL that several twins share."""

#: From a (ep, x, key) and b (ep, y, key), x and y counting from 0: `blocks`, with the longest common block of each stretch as best (-length, x, y).
LONGEST_BLOCKS = """
pairs AS (SELECT ep, x, y, y - x AS diagonal, x - row_number() OVER (PARTITION BY ep, y - x ORDER BY x) AS island FROM a JOIN b USING (ep, key)),
runs AS (SELECT ep, x, y, row_number() OVER (PARTITION BY ep, diagonal, island ORDER BY x DESC) AS run FROM pairs),
stretches AS (
    SELECT ep, 0::BIGINT AS x0, (SELECT count(*) FROM a WHERE a.ep = e.ep) AS x1, 0::BIGINT AS y0, (SELECT count(*) FROM b WHERE b.ep = e.ep) AS y1 FROM (SELECT DISTINCT ep FROM a) e
    UNION ALL
    SELECT ep, CASE WHEN side = 0 THEN x0 ELSE best.x - best.neg END, CASE WHEN side = 0 THEN best.x ELSE x1 END, CASE WHEN side = 0 THEN y0 ELSE best.y - best.neg END, CASE WHEN side = 0 THEN best.y ELSE y1 END
    FROM (SELECT s.ep, x0, x1, y0, y1, min({'neg': -least(run, x1 - r.x, y1 - r.y), 'x': r.x, 'y': r.y}) AS best
          FROM stretches s JOIN runs r ON r.ep = s.ep AND r.x >= x0 AND r.x < x1 AND r.y >= y0 AND r.y < y1 GROUP BY ALL) CROSS JOIN (SELECT unnest([0, 1]) AS side)
    WHERE CASE WHEN side = 0 THEN x0 < best.x AND y0 < best.y ELSE best.x - best.neg < x1 AND best.y - best.neg < y1 END),
blocks AS (SELECT s.ep, x0, y0, min({'neg': -least(run, x1 - r.x, y1 - r.y), 'x': r.x, 'y': r.y}) AS best
           FROM stretches s JOIN runs r ON r.ep = s.ep AND r.x >= x0 AND r.x < x1 AND r.y >= y0 AND r.y < y1 GROUP BY s.ep, x0, x1, y0, y1)"""
