"""SQL twins of the queries, written straight from the definitions (theta joins, correlated sums)."""

from __future__ import annotations

from foldloom.functions.residues import RESIDUES

POINTS = """
steps AS (
  SELECT vec_id AS chain, i AS res_idx, CAST(embedding[3*i+1] AS DOUBLE) AS d0,
         CAST(embedding[3*i+2] AS DOUBLE) AS d1, CAST(embedding[3*i+3] AS DOUBLE) AS d2
  FROM (SELECT vec_id, embedding, unnest(range(21)) AS i FROM embeddings)),
pts AS (
  SELECT chain // 4 AS job_id, chain, CAST(res_idx AS INTEGER) AS res_idx,
         substr('ACDEFGHIKLMNPQRSTVWY', CAST((chain + res_idx) % 20 + 1 AS INTEGER), 1) AS letter,
         (chain * 7 + res_idx) % 11 <> 0 AS present,
         sum(3.8e0 * d0 / sqrt(d0*d0 + d1*d1 + d2*d2)) OVER w AS x,
         sum(3.8e0 * d1 / sqrt(d0*d0 + d1*d1 + d2*d2)) OVER w AS y,
         sum(3.8e0 * d2 / sqrt(d0*d0 + d1*d1 + d2*d2)) OVER w AS z
  FROM steps WINDOW w AS (PARTITION BY chain ORDER BY res_idx ROWS UNBOUNDED PRECEDING))"""
PRESENT = POINTS + ",\nres AS (SELECT job_id, chain, res_idx, letter, x, y, z FROM pts WHERE present)"
BLOCKS = PRESENT + """,
islands AS (
  SELECT *, res_idx - row_number() OVER (PARTITION BY chain ORDER BY res_idx) AS island FROM res),
lab AS (
  SELECT *, CAST(dense_rank() OVER (PARTITION BY chain ORDER BY island) - 1 AS INTEGER) AS block FROM islands),
blk AS (
  SELECT job_id, chain, block, min(res_idx) AS first_idx, max(res_idx) AS last_idx FROM lab GROUP BY ALL)"""
FRAGMENTS = BLOCKS + """,
frag AS (
  SELECT s.job_id, s.chain, s.block, s.res_idx AS pos, l.len
  FROM lab s JOIN blk b USING (job_id, chain, block), (SELECT unnest([5,6,7,8,9]) AS len) l
  WHERE s.res_idx + l.len - 1 <= b.last_idx)"""
PAIRS = FRAGMENTS + """,
pair_points AS (
  SELECT f.job_id AS grp, f.chain AS side1, h.chain AS side2, f.pos AS p1, h.pos AS p2, f.len,
         a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS b_y, b.z AS bz
  FROM frag f JOIN frag h ON f.job_id = h.job_id AND f.len = h.len AND f.chain > h.chain
  JOIN res a ON a.chain = f.chain AND a.res_idx BETWEEN f.pos AND f.pos + f.len - 1
  JOIN res b ON b.chain = h.chain AND b.res_idx - h.pos = a.res_idx - f.pos),
stats AS (
  SELECT grp, side1, side2, p1, p2, len,
         len * (var_pop(ax)+var_pop(ay)+var_pop(az)+var_pop(bx)+var_pop(b_y)+var_pop(bz)) AS e,
         len*covar_pop(ax,bx) AS c0, len*covar_pop(ax,b_y) AS c1, len*covar_pop(ax,bz) AS c2,
         len*covar_pop(ay,bx) AS c3, len*covar_pop(ay,b_y) AS c4, len*covar_pop(ay,bz) AS c5,
         len*covar_pop(az,bx) AS c6, len*covar_pop(az,b_y) AS c7, len*covar_pop(az,bz) AS c8,
         avg(ax) AS m1x, avg(ay) AS m1y, avg(az) AS m1z, avg(bx) AS m2x, avg(b_y) AS m2y, avg(bz) AS m2z
  FROM pair_points GROUP BY grp, side1, side2, p1, p2, len)"""


def singular(source: str, tag: str = "") -> str:
    """CTEs from covariances (c0..c8, e, len) to ``sized`` with rmsd_fast and rmsd; ``tag`` ends their names."""
    return f""",
gram{tag} AS (
  SELECT *, c0*(c4*c8-c5*c7) - c1*(c3*c8-c5*c6) + c2*(c3*c7-c4*c6) AS det,
         c0*c0+c3*c3+c6*c6 AS kxx, c1*c1+c4*c4+c7*c7 AS kyy, c2*c2+c5*c5+c8*c8 AS kzz,
         c0*c1+c3*c4+c6*c7 AS kxy, c0*c2+c3*c5+c6*c8 AS kxz, c1*c2+c4*c5+c7*c8 AS kyz FROM {source}),
means{tag} AS (SELECT *, (kxx+kyy+kzz)/3 AS q FROM gram{tag}),
spreads{tag} AS (
  SELECT *, sqrt(((kxx-q)*(kxx-q)+(kyy-q)*(kyy-q)+(kzz-q)*(kzz-q)+2*(kxy*kxy+kxz*kxz+kyz*kyz))/6) AS p FROM means{tag}),
angles{tag} AS (
  SELECT *, acos(least(greatest(((kxx-q)*((kyy-q)*(kzz-q)-kyz*kyz) - kxy*(kxy*(kzz-q)-kyz*kxz)
         + kxz*(kxy*kyz-(kyy-q)*kxz)) / (2*p*p*p), -1e0), 1e0)) / 3 AS phi FROM spreads{tag}),
roots{tag} AS (
  SELECT *, sqrt(greatest(q + 2*p*cos(phi), 0)) AS s1,
         sqrt(greatest(q + 2*p*cos(phi - 2*pi()/3), 0)) AS s2 FROM angles{tag}),
thirds{tag} AS (
  SELECT *, CASE WHEN s1*s2 > 1e-9 THEN least(greatest(det/(s1*s2), -s2), s2) ELSE 0 END AS s3 FROM roots{tag}),
sized{tag} AS (
  SELECT *, sqrt(greatest(e - 2*(s1+s2+abs(s3)), 0)/len) AS rmsd_fast,
         sqrt(greatest(e - 2*(s1+s2+s3), 0)/len) AS rmsd FROM thirds{tag})"""


# The score table of the fixture: fragments ten positions apart in a chain are the background; the share of pairs below every
# 0.02 Angstrom, straight in between, and below one per cent of the pairs the power law of 3 n - 6 free coordinates.
CURVE = """,
lag_points AS (
  SELECT f.chain AS c, f.pos AS p, f.len, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS b_y, b.z AS bz
  FROM frag f JOIN frag h ON h.chain = f.chain AND h.len = f.len AND h.pos = f.pos + 10
  JOIN res a ON a.chain = f.chain AND a.res_idx BETWEEN f.pos AND f.pos + f.len - 1
  JOIN res b ON b.chain = f.chain AND b.res_idx = a.res_idx + 10),
lag_stats AS (
  SELECT c, p AS at, len, len * (var_pop(ax)+var_pop(ay)+var_pop(az)+var_pop(bx)+var_pop(b_y)+var_pop(bz)) AS e,
         len*covar_pop(ax,bx) AS c0, len*covar_pop(ax,b_y) AS c1, len*covar_pop(ax,bz) AS c2,
         len*covar_pop(ay,bx) AS c3, len*covar_pop(ay,b_y) AS c4, len*covar_pop(ay,bz) AS c5,
         len*covar_pop(az,bx) AS c6, len*covar_pop(az,b_y) AS c7, len*covar_pop(az,bz) AS c8
  FROM lag_points GROUP BY c, p, len)""" + singular("lag_stats", "_lag") + """,
background AS (SELECT least(CAST(ceil(rmsd * 1000) AS INTEGER), 2802) AS bin, len FROM sized_lag),
whole AS (SELECT count(*) AS total, avg(len) AS size FROM background),
steps_up AS (
  SELECT m, sum(coalesce(n, 0)) OVER (ORDER BY m) AS below
  FROM (SELECT unnest(range(2802)) AS m) LEFT JOIN (SELECT bin, count(*) AS n FROM background GROUP BY bin) ON bin = m),
knots AS (SELECT m AS k, below, -ln((below + 1)/(total + 1)) AS v FROM steps_up, whole WHERE m % 20 = 0),
edge AS (SELECT min(k) AS tail FROM knots, whole WHERE k > 0 AND below >= 0.01e0 * total),
curve AS (
  SELECT list(CASE WHEN m < tail THEN v_tail + (3*size - 6) * ln(tail / greatest(m, 1))
                   ELSE a.v + (b.v - a.v) * (m - a.k) / 20e0 END / size ORDER BY m) AS vals
  FROM steps_up JOIN knots a ON a.k = m - m % 20 JOIN knots b ON b.k = least(m - m % 20 + 20, 2800), whole, edge,
       (SELECT v AS v_tail FROM knots, edge WHERE k = tail))"""
SCORED = CURVE + """,
scored AS (
  SELECT * EXCLUDE (vals), CASE WHEN rmsd > 2.8e0 THEN 0 ELSE len * (
    vals[CAST(floor(rmsd*1000) AS INTEGER) + 1] * (1 - (rmsd*1000 - floor(rmsd*1000)))
    + vals[CAST(floor(rmsd*1000) AS INTEGER) + 2] * (rmsd*1000 - floor(rmsd*1000))) END AS score FROM sized, curve)"""
MATCHES = PAIRS + singular("stats") + SCORED
NEIGHBOURS = PRESENT + """,
stats AS (
  SELECT a.job_id, a.chain, CAST(count(*) AS INTEGER) AS len,
         count(*)*(var_pop(a.x)+var_pop(a.y)+var_pop(a.z)+var_pop(b.x)+var_pop(b.y)+var_pop(b.z)) AS e,
         count(*)*covar_pop(a.x,b.x) AS c0, count(*)*covar_pop(a.x,b.y) AS c1, count(*)*covar_pop(a.x,b.z) AS c2,
         count(*)*covar_pop(a.y,b.x) AS c3, count(*)*covar_pop(a.y,b.y) AS c4, count(*)*covar_pop(a.y,b.z) AS c5,
         count(*)*covar_pop(a.z,b.x) AS c6, count(*)*covar_pop(a.z,b.y) AS c7, count(*)*covar_pop(a.z,b.z) AS c8
  FROM res a JOIN res b ON b.job_id = a.job_id AND b.chain = a.chain + 1 AND b.res_idx = a.res_idx
  GROUP BY a.job_id, a.chain)""" + singular("stats")
CELLS = PRESENT + """,
cells AS (
  SELECT job_id, CAST(0 AS BIGINT) AS aln_id, CAST(chain % 4 AS INTEGER) AS slot, chain, res_idx AS col, res_idx, x, y, z FROM res)"""
CHAINS = POINTS + ", chains AS (SELECT DISTINCT job_id, chain FROM pts)"
BONDS = POINTS + """,
near AS (
  SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz,
         lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz
  FROM pts WINDOW w AS (PARTITION BY chain ORDER BY res_idx)),
crossed AS (
  SELECT *, (ny-y)*(z-pz) - (nz-z)*(y-py) AS sx, (nz-z)*(x-px) - (nx-x)*(z-pz) AS sy, (nx-x)*(y-py) - (ny-y)*(x-px) AS sz,
         x + (nx-x)*0.4e0 AS cx, y + (ny-y)*0.4e0 AS cy, z + (nz-z)*0.4e0 AS cz,
         x - (x-px)*0.4e0 AS ntx, y - (y-py)*0.4e0 AS nty, z - (z-pz)*0.4e0 AS ntz FROM near),
backbone AS (
  SELECT *, cx + sx/nullif(sqrt(sx*sx+sy*sy+sz*sz), 0) AS ox, cy + sy/nullif(sqrt(sx*sx+sy*sy+sz*sz), 0) AS oy,
         cz + sz/nullif(sqrt(sx*sx+sy*sy+sz*sz), 0) AS oz FROM crossed),
prev AS (
  SELECT a.*, b.cx - b.ox AS ux, b.cy - b.oy AS uy, b.cz - b.oz AS uz
  FROM backbone a JOIN backbone b ON a.chain = b.chain AND b.res_idx = a.res_idx - 1),
donors AS (
  SELECT job_id, chain, res_idx, x, y, z, ntx, nty, ntz, ntx + ux/sqrt(ux*ux+uy*uy+uz*uz) AS hx,
         nty + uy/sqrt(ux*ux+uy*uy+uz*uz) AS hy, ntz + uz/sqrt(ux*ux+uy*uy+uz*uz) AS hz
  FROM prev WHERE letter <> 'P' AND cx IS NOT NULL AND ox IS NOT NULL AND ux IS NOT NULL),
apart AS (
  SELECT d.job_id, d.chain, d.res_idx AS donor, a.res_idx AS acceptor,
         sqrt((d.hx-a.ox)**2+(d.hy-a.oy)**2+(d.hz-a.oz)**2) AS ho, sqrt((d.hx-a.cx)**2+(d.hy-a.cy)**2+(d.hz-a.cz)**2) AS hc,
         sqrt((d.ntx-a.ox)**2+(d.nty-a.oy)**2+(d.ntz-a.oz)**2) AS no, sqrt((d.ntx-a.cx)**2+(d.nty-a.cy)**2+(d.ntz-a.cz)**2) AS nc
  FROM donors d JOIN backbone a ON a.chain = d.chain AND a.res_idx NOT IN (d.res_idx, d.res_idx - 1)
  WHERE a.cx IS NOT NULL AND a.ox IS NOT NULL AND (d.x-a.x)**2+(d.y-a.y)**2+(d.z-a.z)**2 <= 81e0),
energies AS (
  SELECT *, CASE WHEN least(ho, hc, no, nc) < 0.5e0 THEN -9900e0
         ELSE -27888e0 * (1/ho - 1/hc + 1/nc - 1/no) END AS energy FROM apart),
bonds AS (
  SELECT * FROM (SELECT job_id, chain, donor, acceptor, energy,
    CAST(row_number() OVER (PARTITION BY chain, donor ORDER BY energy, acceptor) AS INTEGER) AS rank
    FROM energies WHERE energy < -500e0) WHERE rank <= 2)"""
DOCS = """docs AS (
  SELECT doc_id AS job_id, source || ':' || doc_id AS id_string, translate(regexp_replace(text, '\\P{L}', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS row FROM documents)"""
QUATERNIONS = """quats AS (
  SELECT vec_id, CAST(embedding[1] AS DOUBLE) a, CAST(embedding[2] AS DOUBLE) b, CAST(embedding[3] AS DOUBLE) c, CAST(embedding[4] AS DOUBLE) d,
         CAST(embedding[5] AS DOUBLE) e, CAST(embedding[6] AS DOUBLE) f, CAST(embedding[7] AS DOUBLE) g, CAST(embedding[8] AS DOUBLE) h,
         embedding FROM embeddings),
units AS (
  SELECT *, sqrt(a*a+b*b+c*c+d*d) AS n1, sqrt(e*e+f*f+g*g+h*h) AS n2 FROM quats)"""


def _xyz(*names: str, digits: int = 4) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


ORACLES: dict[str, str] = {
    "chain_points": f"WITH {POINTS} SELECT job_id, chain, res_idx, letter, present, {_xyz('x', 'y', 'z')} FROM pts",
    "blocks_islands": f"WITH {BLOCKS} SELECT * FROM blk",
    "block_gaps": f"""WITH {BLOCKS},
ends AS (SELECT job_id, chain, block AS gap, coalesce(lag(last_idx) OVER (PARTITION BY chain ORDER BY block), -1) + 1 AS gap_first,
         first_idx - 1 AS gap_last FROM blk),
tails AS (SELECT job_id, chain, max(block) + 1 AS gap, max(last_idx) + 1 AS gap_first, 20 AS gap_last FROM blk GROUP BY job_id, chain)
SELECT * FROM ends UNION ALL SELECT * FROM tails""",
    "residue_to_block": f"""WITH {BLOCKS}
SELECT job_id, chain, res_idx, CAST(coalesce((SELECT max(block) FROM blk b WHERE b.chain = p.chain AND b.first_idx <= p.res_idx), 0) AS INTEGER)
  AS move_block FROM pts p""",
    "sliding_fragments": f"""WITH {FRAGMENTS},
f AS (
  SELECT f.job_id AS grp, f.chain AS side, f.pos, f.len, avg(x) AS mx, avg(y) AS my, avg(z) AS mz,
         f.len*(var_pop(x)+var_pop(y)+var_pop(z)) AS extent
  FROM frag f JOIN res r ON r.chain = f.chain AND r.res_idx BETWEEN f.pos AND f.pos + f.len - 1 GROUP BY f.job_id, f.chain, f.pos, f.len)
SELECT grp, side, pos, len, {_xyz('mx', 'my', 'mz', 'extent')} FROM f""",
    "fragment_rmsd": f"WITH {MATCHES} SELECT grp, side1, side2, p1, p2, len, {_xyz('rmsd_fast', 'rmsd')} FROM scored WHERE score >= 0.6",
    "fragment_scores": f"WITH {MATCHES} SELECT grp, side1, side2, p1, p2, len, {_xyz('score')} FROM scored WHERE score >= 2.0",
    "best_match_per_pair": f"""WITH {MATCHES},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY side1, side2 ORDER BY score DESC, p1, p2, len) AS rn,
         count(*) OVER (PARTITION BY side1, side2) AS n_matches FROM scored WHERE score >= 0.6)
SELECT grp, side1, side2, p1, p2, len, {_xyz('rmsd', 'score')}, n_matches FROM ranked WHERE rn = 1""",
    "chain_pairs": f"WITH {MATCHES} SELECT grp, side1, side2, count(*) AS n_matches FROM scored WHERE score >= 0.6 GROUP BY ALL",
    "chain_superposition": f"""WITH {NEIGHBOURS}
SELECT job_id, chain, len, {_xyz('rmsd_fast', 'rmsd')}, round((rmsd - 0.155e0*len + 1.6018e0)/2.13065e0, 4) AS z FROM sized""",
    "map_residuals": f"WITH {MATCHES} SELECT grp, side1, side2, p1, p2, len, round(rmsd, 4) AS residual FROM scored WHERE score >= 1.6",
    "hinge_scores": f"""WITH {QUATERNIONS},
halves AS (SELECT vec_id, abs(a*e+b*f+c*g+d*h)/(n1*n2) AS half_cosine,
  sqrt((CAST(embedding[9] AS DOUBLE)-embedding[12])**2 + (CAST(embedding[10] AS DOUBLE)-embedding[13])**2 + (CAST(embedding[11] AS DOUBLE)-embedding[14])**2) AS disp FROM units)
SELECT vec_id, round(half_cosine, 4) AS half_cosine, round(-ln((1 - cos(greatest(2*acos(least(half_cosine, 1)), 0.1e0)))/2), 4) AS angle_bonus,
  round(4 - disp, 4) AS displacement_bonus FROM halves""",
    "affine_moves": f"""WITH {POINTS}, {QUATERNIONS},
u AS (SELECT vec_id AS chain, a/n1 AS qx, b/n1 AS qy, c/n1 AS qz, d/n1 AS qw, e AS tx, f AS ty, g AS tz FROM units),
moved AS (
  SELECT p.chain, p.res_idx, p.x AS back_x, p.y AS back_y, p.z AS back_z, abs(qw) AS w, 1e0 AS determinant,
    (1-2*(qy*qy+qz*qz))*x + 2*(qx*qy-qz*qw)*y + 2*(qx*qz+qy*qw)*z + tx AS x,
    2*(qx*qy+qz*qw)*x + (1-2*(qx*qx+qz*qz))*y + 2*(qy*qz-qx*qw)*z + ty AS y,
    2*(qx*qz-qy*qw)*x + 2*(qy*qz+qx*qw)*y + (1-2*(qx*qx+qy*qy))*z + tz AS z
  FROM pts p JOIN u USING (chain))
SELECT chain, res_idx, {_xyz('x', 'y', 'z', 'back_x', 'back_y', 'back_z', 'w', 'determinant')} FROM moved""",
    "column_rmsd": f"""WITH {CELLS},
pairs AS (
  SELECT a.job_id, a.aln_id, a.col, avg((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) AS d2
  FROM cells a JOIN cells b ON a.job_id = b.job_id AND a.col = b.col AND a.slot < b.slot GROUP BY ALL)
SELECT job_id, aln_id, round(sqrt(avg(d2)), 4) AS rmsd, count(*) AS n_cols FROM pairs GROUP BY job_id, aln_id""",
    "leave_one_out_mean": f"""WITH {CELLS}
SELECT a.job_id, a.aln_id, a.col, a.slot, round(avg(b.x), 4) AS other_x, round(avg(b.y), 4) AS other_y, round(avg(b.z), 4) AS other_z
FROM cells a LEFT JOIN cells b ON a.job_id = b.job_id AND a.col = b.col AND a.slot <> b.slot GROUP BY a.job_id, a.aln_id, a.col, a.slot""",
    "weighted_means": f"""WITH {CELLS}, allcols AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS aln_id, res_idx AS col FROM pts)
SELECT c.job_id, c.aln_id, c.col, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z
FROM allcols c LEFT JOIN cells a ON a.job_id = c.job_id AND a.col = c.col AND a.slot <> 0 GROUP BY c.job_id, c.aln_id, c.col""",
    "core_columns": f"""WITH {CELLS}, n AS (SELECT job_id, count(DISTINCT chain) AS n_chains FROM pts GROUP BY job_id)
SELECT job_id, aln_id, col, n_chains FROM cells JOIN n USING (job_id) GROUP BY job_id, aln_id, col, n_chains HAVING count(*) = n_chains""",
    "core_counts": f"""WITH {CELLS}, n AS (SELECT job_id, count(DISTINCT chain) AS n_chains FROM pts GROUP BY job_id),
core AS (SELECT job_id, aln_id, col FROM cells JOIN n USING (job_id) GROUP BY job_id, aln_id, col, n_chains HAVING count(*) = n_chains)
SELECT job_id, aln_id, count(*) AS core FROM core GROUP BY job_id, aln_id""",
    "conflict_pairs": f"""WITH {CHAINS},
cols AS (
  SELECT job_id, chain, col, CAST(col - 2*(col // 7) + CASE WHEN chain % 2 = 1 AND col >= 7 THEN 1 ELSE 0 END AS INTEGER) AS res_idx
  FROM chains, (SELECT CAST(unnest(range(27)) AS INTEGER) AS col))
SELECT DISTINCT a.job_id, CAST(0 AS BIGINT) AS aln_id, a.col AS earlier, b.col AS later
FROM cols a JOIN cols b ON a.chain = b.chain AND a.col < b.col AND a.res_idx >= b.res_idx""",
    "bounding_boxes": f"""WITH {CELLS}
SELECT job_id, aln_id, {', '.join(f'round({f}({c}), 4) AS {f}_{c}' for c in 'xyz' for f in ('min', 'max'))} FROM cells GROUP BY job_id, aln_id""",
    "radius_join": f"""WITH {PRESENT},
near AS (
  SELECT a.job_id, a.chain AS a_chain, a.res_idx AS a_res_idx, b.chain AS b_chain, b.res_idx AS b_res_idx,
         sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) AS distance FROM res a JOIN res b ON a.job_id = b.job_id AND a.chain > b.chain)
SELECT job_id, a_chain, a_res_idx, b_chain, b_res_idx, round(distance, 4) AS distance FROM near WHERE distance <= 5""",
    "nearest_segment": f"""WITH {PRESENT},
seg AS (
  SELECT a.job_id, CASE WHEN a.res_idx < 10 THEN 0 ELSE 1 END AS gap, a.chain, a.res_idx AS pos, a.x, a.y, a.z, b.x AS x1, b.y AS y1, b.z AS z1
  FROM res a JOIN res b ON a.chain = b.chain AND b.res_idx = a.res_idx + 1 WHERE a.res_idx <> 9),
pairs AS (
  SELECT a.job_id, CAST(0 AS BIGINT) AS aln_id, a.gap, a.chain, a.pos, b.chain AS chain2, b.pos AS pos2,
    sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) + sqrt((a.x1-b.x1)**2+(a.y1-b.y1)**2+(a.z1-b.z1)**2) AS distance
  FROM seg a JOIN seg b ON a.job_id = b.job_id AND a.gap = b.gap AND a.chain <> b.chain)
SELECT job_id, aln_id, gap, chain, pos, chain2, arg_min(pos2, distance) AS pos2, round(min(distance), 4) AS distance
FROM pairs WHERE distance <= 12 GROUP BY job_id, aln_id, gap, chain, pos, chain2""",
    # every column walks left over the whole alignment, one a step, without stretches
    "column_compaction": f"""WITH RECURSIVE {PRESENT},
wide AS (
  SELECT job_id, chain, CAST(chain % 4 AS INTEGER) AS slot, res_idx, letter,
    res_idx * 4 + CASE WHEN res_idx % 6 = 0 OR (chain * 7 + res_idx // 2 * 3) % 5 >= 3 THEN 0 ELSE (chain * 3 + res_idx) % 4 END AS w FROM res),
cells AS (SELECT *, dense_rank() OVER (PARTITION BY job_id ORDER BY w) AS pos FROM wide),
cols AS (SELECT job_id, pos, min(slot) AS f, CAST(sum(1 << slot) AS BIGINT) AS m FROM cells GROUP BY ALL),
walk AS (
  SELECT job_id, 1::BIGINT AS k, [{{'f': f, 'm': m, 'p': pos}}] AS seq FROM cols WHERE pos = 1
  UNION ALL
  SELECT job_id, k + 1, list_concat(list_concat(list_slice(seq, 1, spot), [{{'f': f, 'm': m, 'p': pos}}]), list_slice(seq, spot + 1, len(seq))) FROM (
    SELECT w.job_id, w.k, w.seq, c.f, c.m, c.pos,
      coalesce(list_max(list_filter(range(1, len(w.seq) + 1), lambda i: c.f >= w.seq[i].f OR (c.m & w.seq[i].m) <> 0)), 0) AS spot
    FROM walk w JOIN cols c ON c.job_id = w.job_id AND c.pos = w.k + 1)),
placed AS (
  SELECT job_id, unnest(seq).p AS pos, unnest(range(len(seq))) AS place FROM walk
  WHERE k = (SELECT max(pos) FROM cols c WHERE c.job_id = walk.job_id)),
grid AS (SELECT p.job_id, p.pos, p.place, s.chain, s.slot FROM placed p JOIN (SELECT DISTINCT job_id, chain, slot FROM cells) s ON s.job_id = p.job_id)
SELECT g.job_id, CAST(0 AS BIGINT) AS aln_id, g.slot, g.chain, string_agg(coalesce(letter, '-'), '' ORDER BY g.place) AS "row",
  string_agg(coalesce(letter, '-'), '' ORDER BY g.pos) AS scattered
FROM grid g LEFT JOIN cells c ON c.job_id = g.job_id AND c.chain = g.chain AND c.pos = g.pos GROUP BY ALL""",
    "fasta_lines": f"""WITH {DOCS}
SELECT job_id, CAST(0 AS BIGINT) AS minor, '>' || id_string AS line FROM docs UNION ALL
SELECT job_id, k + 1 AS minor, substr(row, CAST(k*60 + 1 AS BIGINT), 60) AS line
FROM (SELECT job_id, row, unnest(range((length(row) + 59) // 60)) AS k FROM docs)""",
    "pir_lines": f"""WITH {DOCS},
parts AS (SELECT job_id, row, k, substr(row, CAST(k*60 + 1 AS BIGINT), 60) AS part, (length(row) + 59) // 60 AS n
  FROM (SELECT job_id, row, unnest(range((length(row) + 59) // 60)) AS k FROM docs))
SELECT job_id, CAST(-2 AS BIGINT) AS minor, '>P1;' || id_string AS line FROM docs UNION ALL
SELECT job_id, CAST(-1 AS BIGINT), id_string FROM docs UNION ALL
SELECT job_id, k, ' ' || regexp_replace(part, '(.{{1,10}})', ' \\1', 'g') || CASE WHEN k = n - 1 THEN '*' ELSE '' END FROM parts UNION ALL
SELECT job_id, n, '' FROM parts WHERE k = n - 1 UNION ALL
SELECT job_id, unnest([0, 1]), unnest([' *', '']) FROM docs WHERE row = ''""",
    "msf_checksums": f"""WITH {DOCS},
letters AS (SELECT job_id, unnest(string_split(row, '')) AS c, unnest(range(length(row))) AS i FROM docs)
SELECT d.job_id, CAST(coalesce(sum((i % 57 + 1) * ascii(c)) % 10000, 0) AS BIGINT) AS checksum FROM docs d LEFT JOIN letters l ON l.job_id = d.job_id GROUP BY d.job_id""",
    "coordinate_lines": f"""WITH {PRESENT}
SELECT 'job' || job_id AS path, CAST((chain % 4) * 100 + res_idx AS INTEGER) AS line_no,
  printf('ATOM  %5d  CA  ALA %s%4d    %8.3f%8.3f%8.3f  1.00  0.00           C  ', CAST(res_idx + 1 AS INTEGER),
  substr('ABCDEFGH', CAST(chain % 4 + 1 AS INTEGER), 1), CAST(res_idx + 1 AS INTEGER), x, y, z) AS line FROM res""",
    "structure_atoms": f"""WITH {PRESENT}
SELECT 'job' || job_id AS path, 0 AS model_no, substr('ABCDEFGH', CAST(chain % 4 + 1 AS INTEGER), 1) AS chain_id, res_idx + 1 AS serial, ' CA ' AS name,
  'ALA' AS res_name, res_idx + 1 AS res_num, {_xyz('x', 'y', 'z', digits=3)}, 'C' AS element,
  CAST(row_number() OVER w - 1 AS INTEGER) AS run, CAST(row_number() OVER w - 1 AS INTEGER) AS atom_ord
FROM res WINDOW w AS (PARTITION BY chain ORDER BY res_idx)""",
    "sequence_reconciliation": f"""WITH {POINTS}, names AS (SELECT * FROM (VALUES {', '.join(f"('{letter}', '{name}')" for name, letter in RESIDUES[:20])}) t(letter, res_name))
SELECT 'job' || job_id AS path, substr('ABCDEFGH', CAST(chain % 4 + 1 AS INTEGER), 1) AS chain_id, res_idx, res_name, res_idx + 1 AS res_num, letter,
  CASE WHEN present THEN round(x, 3) END AS x, CASE WHEN present THEN round(y, 3) END AS y, CASE WHEN present THEN round(z, 3) END AS z
FROM pts JOIN names USING (letter)""",
    "job_split": """WITH lines AS (
  SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS line_no, trim(CASE WHEN o_orderkey % 5 = 0 THEN '-o out' || o_orderkey
    WHEN o_orderkey % 7 = 0 THEN '# note ' || o_orderkey WHEN o_orderkey % 11 = 0 THEN '  ' ELSE '  s' || o_orderkey || ':A ' END) AS line FROM orders),
kept AS (SELECT *, CASE WHEN starts_with(line, '-o ') THEN substr(line, 4) END AS p FROM lines WHERE line <> '' AND NOT starts_with(line, '#')),
marked AS (SELECT k.*, (SELECT count(*) FROM kept o WHERE o.path = k.path AND o.line_no <= k.line_no AND o.p IS NOT NULL) AS job_id,
  coalesce((SELECT arg_max(o.p, o.line_no) FROM kept o WHERE o.path = k.path AND o.line_no <= k.line_no AND o.p IS NOT NULL), 'alignment') AS out_prefix FROM kept k)
SELECT path, job_id, out_prefix, CAST(row_number() OVER (PARTITION BY path, job_id ORDER BY line_no) - 1 AS INTEGER) AS sel_ord, line AS selector
FROM marked WHERE p IS NULL""",
    "selector_parse": """WITH o AS (SELECT o_orderkey AS k, 's' || o_orderkey AS file FROM orders),
made AS (
  SELECT k, file, k % 6 > 1 AS has_selector, unnest(CASE CAST(k % 6 AS INTEGER)
    WHEN 0 THEN [{'g':0,'c':0,'m':NULL::INTEGER,'l':NULL::VARCHAR,'a':NULL::INTEGER,'b':NULL::VARCHAR,'y':NULL::INTEGER,'z':NULL::VARCHAR}]
    WHEN 1 THEN [{'g':0,'c':0,'m':NULL,'l':NULL,'a':NULL,'b':NULL,'y':NULL,'z':NULL}]
    WHEN 2 THEN [{'g':0,'c':0,'m':NULL,'l':'A','a':NULL,'b':NULL,'y':NULL,'z':NULL}, {'g':0,'c':1,'m':NULL,'l':'b','a':NULL,'b':NULL,'y':NULL,'z':NULL},
                 {'g':0,'c':2,'m':NULL,'l':'C','a':NULL,'b':NULL,'y':NULL,'z':NULL}]
    WHEN 3 THEN [{'g':0,'c':0,'m':CAST(k % 4 AS INTEGER),'l':NULL,'a':NULL,'b':NULL,'y':NULL,'z':NULL}]
    WHEN 4 THEN [{'g':0,'c':0,'m':2,'l':'A','a':CAST(k % 50 AS INTEGER),'b':NULL,'y':CAST(k % 50 + 9 AS INTEGER),'z':'B'},
                 {'g':0,'c':1,'m':2,'l':'C','a':NULL,'b':NULL,'y':NULL,'z':NULL}, {'g':1,'c':0,'m':NULL,'l':'D','a':NULL,'b':NULL,'y':NULL,'z':NULL}]
    ELSE [{'g':0,'c':0,'m':1,'l':'A','a':NULL,'b':NULL,'y':NULL,'z':NULL},
          {'g':1,'c':0,'m':0,'l':'B','a':-3,'b':NULL,'y':CAST(k % 9 AS INTEGER),'z':NULL}] END) AS s FROM o)
SELECT k AS job_id, file, has_selector, s.g AS group_ord, s.c AS chain_ord, s.m AS model, s.l AS chain, s.a AS range_first, s.b AS code_first,
  s.y AS range_last, s.z AS code_last FROM made""",
    "hydrogen_bonds": f"WITH {BONDS} SELECT job_id, chain, donor, acceptor, round(energy, 2) AS energy, rank FROM bonds",
    "pairwise_pvalue": f"""WITH {NEIGHBOURS},
zs AS (SELECT job_id, chain, (rmsd - 0.155e0*len + 1.6018e0)/2.13065e0 AS z FROM sized),
slices AS (SELECT job_id, chain, z/1000 AS h, unnest(range(1000)) AS i FROM zs)
SELECT job_id, chain, round(0.5e0 + sum(h/6 * (exp(-0.5e0*(h*i)*(h*i)) + 4*exp(-0.5e0*(h*(i+0.5e0))*(h*(i+0.5e0)))
  + exp(-0.5e0*(h*(i+1))*(h*(i+1))))) / sqrt(2*pi()), 5) AS pvalue FROM slices GROUP BY job_id, chain""",
}

# The rotation from the covariance C in closed form: ((k + |C|^2) C + l cof(C) - C C^T C) / (k l - det C), k = (l^2 - |C|^2) / 2, where
# l, the sum of the signed singular values, solves (l^2 - |C|^2)^2 = 8 l det C + 4 |cof C|^2 (two Newton steps).
_COF = ("c4*c8-c5*c7", "c5*c6-c3*c8", "c3*c7-c4*c6", "c2*c7-c1*c8", "c0*c8-c2*c6", "c1*c6-c0*c7", "c1*c5-c2*c4", "c2*c3-c0*c5", "c0*c4-c1*c3")
_NEWTON = "l - ((l*l-q)*(l*l-q) - 8*det*l - 4*a) / (4*l*(l*l-q) - 8*det)"
_GRAM = [" + ".join(f"c{3*i+k}*c{3*j+k}" for k in range(3)) for i in range(3) for j in range(3)]
_ROTATION = ", ".join(
    f"((k+q)*c{n} + l*f{n} - ({' + '.join(f'g{3*(n//3)+k}*c{3*k+n%3}' for k in range(3))})) / (k*l - det) AS r{n}" for n in range(9))
_MAP = {
    "determinant": "r0*(r4*r8-r5*r7) - r1*(r3*r8-r5*r6) + r2*(r3*r7-r4*r6)", **{f"r{n}": f"r{n}" for n in range(9)},
    "tx": "m1x - (r0*m2x+r1*m2y+r2*m2z)", "ty": "m1y - (r3*m2x+r4*m2y+r5*m2z)", "tz": "m1z - (r6*m2x+r7*m2y+r8*m2z)"}
ORACLES["rotation_maps"] = f"""WITH {MATCHES},
strong AS (SELECT *, c0*c0+c1*c1+c2*c2+c3*c3+c4*c4+c5*c5+c6*c6+c7*c7+c8*c8 AS nq,
  {', '.join(f'{e} AS f{n}' for n, e in enumerate(_COF))}, {', '.join(f'{e} AS g{n}' for n, e in enumerate(_GRAM))} FROM scored WHERE score >= 1.6),
sums AS (SELECT * EXCLUDE (q, p), s1+s2+s3 AS l, nq AS q, f0*f0+f1*f1+f2*f2+f3*f3+f4*f4+f5*f5+f6*f6+f7*f7+f8*f8 AS a FROM strong),
once AS (SELECT * REPLACE ({_NEWTON} AS l) FROM sums),
twice AS (SELECT * REPLACE ({_NEWTON} AS l) FROM once),
kappa AS (SELECT *, (l*l-q)/2 AS k FROM twice),
turned AS (SELECT *, {_ROTATION} FROM kappa)
SELECT grp, side1, side2, p1, p2, len, {', '.join(f'CASE WHEN round({e}, 4) = 0 THEN 0 ELSE round({e}, 4) END AS {n}' for n, e in _MAP.items())} FROM turned"""


# Staged search and chaining over all matches of a chain pair: theta joins for the hinges, one recursion over side-1 columns for each pass.
def _pass(k: int, min_score: float, displacement: float) -> str:
    """CTEs of one pass: matches admitted to the gaps of the chain before, their edges, best sums by column, the chain."""
    if k == 1:
        admitted = f"SELECT *, CAST(0 AS BIGINT) AS g_in, CAST(0 AS BIGINT) AS g_out FROM cand WHERE score >= {min_score}"
    else:
        admitted = f"""
  SELECT n.* EXCLUDE (cnt, ok), coalesce(b.ord, cnt) AS g_in, coalesce(b.ord + 1, cnt) AS g_out
  FROM (SELECT c.*, count(*) FILTER (r.p1 + r.len <= c.p1) AS cnt, coalesce(bool_and(
          (r.p1 + r.len <= c.p1 AND r.p2 + r.len <= c.p2) OR (c.p1 + c.len <= r.p1 AND c.p2 + c.len <= r.p2)), true) AS ok
        FROM cand c LEFT JOIN chain{k - 1} r ON r.g = c.g GROUP BY ALL) n
  LEFT JOIN chain{k - 1} b ON b.g = n.g AND b.id = n.id WHERE b.id IS NOT NULL OR (ok AND n.score >= {min_score})"""
    bounds = "0" if k == 1 else f"coalesce((SELECT count(*) FROM chain{k - 1} r WHERE r.g = d.g), 0)"
    return f""",
adm{k} AS MATERIALIZED ({admitted}),
step{k} AS MATERIALIZED (
  SELECT e.* FROM edges e JOIN adm{k} a ON a.g = e.g AND a.id = e.before JOIN adm{k} b ON b.g = e.g AND b.id = e.after
  WHERE a.g_out = b.g_in AND displacement <= {displacement}),
dp{k} AS (
  SELECT g, id, p1, g_in, g_out, score, -1 AS c, CAST(NULL AS DOUBLE) AS total, CAST(NULL AS BIGINT) AS back FROM adm{k}
  UNION ALL
  SELECT d.g, d.id, d.p1, d.g_in, d.g_out, d.score, d.c + 1,
    CASE WHEN d.p1 <> d.c + 1 THEN d.total WHEN w.v >= CASE d.g_in WHEN 0 THEN 0 ELSE -5000 END THEN CASE WHEN w.v >= 0 THEN w.v + d.score END
         WHEN d.g_in = 0 THEN d.score END,
    CASE WHEN d.p1 = d.c + 1 AND w.v >= CASE d.g_in WHEN 0 THEN 0 ELSE -5000 END THEN w.before ELSE d.back END
  FROM dp{k} d LEFT JOIN (
    SELECT e.g, e.after, max(f.total + e.bonus) AS v, arg_max(e.before, f.total + e.bonus) AS before
    FROM dp{k} f JOIN step{k} e ON e.g = f.g AND e.before = f.id WHERE f.total IS NOT NULL GROUP BY e.g, e.after) w
    ON w.g = d.g AND w.after = d.id AND d.p1 = d.c + 1
  WHERE d.c < 20),
done{k} AS MATERIALIZED (SELECT * FROM dp{k} d WHERE c = 20 AND total IS NOT NULL),
path{k} AS (
  SELECT g, arg_max(id, total) AS id FROM done{k} d WHERE g_out = {bounds} GROUP BY g
  UNION ALL SELECT d.g, d.back FROM path{k} p JOIN done{k} d ON d.g = p.g AND d.id = p.id WHERE d.back IS NOT NULL),
chain{k} AS MATERIALIZED (
  SELECT a.*  EXCLUDE (g_in, g_out), d.total, row_number() OVER (PARTITION BY a.g ORDER BY a.id) - 1 AS ord
  FROM path{k} p JOIN adm{k} a ON a.g = p.g AND a.id = p.id JOIN done{k} d ON d.g = p.g AND d.id = p.id)"""


def _moved(m: str, p: str) -> list[str]:
    return [f"{m}.r{3*k}*{p}.x + {m}.r{3*k+1}*{p}.y + {m}.r{3*k+2}*{p}.z + {m}.t{c}" for k, c in enumerate("xyz")]


def _apart(one: list[str], two: list[str]) -> str:
    return "sqrt(" + " + ".join(f"(({a}) - ({b}))**2" for a, b in zip(one, two, strict=True)) + ")"


_TURNED = ORACLES["rotation_maps"].split("\nSELECT grp, side1")[0].replace("score >= 1.6", "score >= 0.6").replace("WITH", "WITH RECURSIVE", 1)
SEARCH = _TURNED + f""",
cand AS MATERIALIZED (
  SELECT concat_ws(':', grp, side1, side2) AS g, (CAST(p1 AS BIGINT) << 34) + (CAST(p2 AS BIGINT) << 4) + len AS id, grp, side1, side2, p1, p2, len, score,
    {', '.join(f'r{n}' for n in range(9))}, {_MAP['tx']} AS tx, {_MAP['ty']} AS ty, {_MAP['tz']} AS tz FROM turned),
hinges AS (
  SELECT a.g, a.id AS before, b.id AS after, a.p2 + a.len - 1 AS end2,
    sqrt(greatest({' + '.join(f'a.r{n}*b.r{n}' for n in range(9))} + 1, 0)/4) AS half_cosine,
    ({_apart(_moved('a', 'e'), _moved('b', 'e'))} + {_apart(_moved('a', 's'), _moved('b', 's'))})/2 AS displacement
  FROM cand a JOIN cand b ON a.g = b.g AND a.p1 + a.len <= b.p1 AND a.p2 + a.len <= b.p2
  JOIN res e ON e.chain = a.side2 AND e.res_idx = a.p2 + a.len - 1 JOIN res s ON s.chain = b.side2 AND s.res_idx = b.p2),
edges AS MATERIALIZED (
  SELECT g, before, after, end2, displacement, -ln((1 - cos(greatest(2*acos(least(half_cosine, 1)), 0.1e0)))/2) + 4 - displacement AS bonus
  FROM hinges WHERE half_cosine >= cos(pi()/8) AND displacement <= 10)""" + _pass(1, 2.0, 4) + _pass(2, 1.6, 5) + _pass(3, 0.6, 10)
ORACLES["pair_regions"] = SEARCH + """
SELECT g AS grp, CAST(ord AS INTEGER) AS ord, p1, p2, len, round(score, 3) AS score, round(total, 3) AS total FROM chain3"""
ORACLES["pair_alignment"] = SEARCH + """
SELECT grp AS job_id, g AS grp, side1 AS aln1, side2 AS aln2, round(arg_max(total, ord), 3) AS score, CAST(sum(len) AS INTEGER) AS n_cols,
  CAST(count(*) AS INTEGER) AS n_blocks FROM chain3 GROUP BY ALL"""

# Helices as scanned: at every position of a chain the run that begins there, forward bonds first, unless a helix still covers it.
ORACLES["helix_runs"] = f"""WITH RECURSIVE {BONDS},
b AS (SELECT DISTINCT job_id, chain, donor, acceptor FROM bonds),
spots AS (SELECT c.*, step, CAST(i AS INTEGER) AS i FROM (SELECT DISTINCT job_id, chain FROM b) c, (SELECT unnest([3, 4, 5]) AS step), (SELECT unnest(range(21)) AS i)),
runs AS (
  SELECT job_id, chain, step, i,
    (SELECT min(k) FROM (SELECT unnest(range(22)) AS k) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.chain = s.chain AND donor = s.i + k AND acceptor = s.i + k + step)) AS f,
    (SELECT min(k) FROM (SELECT unnest(range(22)) AS k) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.chain = s.chain AND acceptor = s.i + k AND donor = s.i + k + step)) AS r
  FROM spots s),
scan AS (
  SELECT job_id, chain, step, -1 AS i, 0 AS free, CAST(NULL AS INTEGER) AS length FROM runs WHERE i = 0
  UNION ALL
  SELECT n.job_id, n.chain, n.step, n.i, CAST(CASE WHEN n.i < free THEN free WHEN f >= 2 THEN n.i + f WHEN r >= 2 THEN n.i + r ELSE free END AS INTEGER),
    CAST(CASE WHEN n.i < free THEN NULL WHEN f >= 2 THEN f + n.step - 1 WHEN r >= 2 THEN r + n.step END AS INTEGER)
  FROM scan p JOIN runs n ON n.chain = p.chain AND n.step = p.step AND n.i = p.i + 1)
SELECT job_id, chain, i AS start, length, CASE step WHEN 4 THEN 1 WHEN 3 THEN 5 ELSE 3 END AS class FROM scan WHERE length IS NOT NULL"""

# Ladders as scanned: each bond in order walks its rungs both ways, unless a ladder accepted before pairs its residues.
_ALIGNED = """len(list_filter(acc, lambda p: p.s1 <= least({a}, {b}) AND least({a}, {b}) < p.s1 + p.n
      AND p.s2 + p.d * (least({a}, {b}) - p.s1) = greatest({a}, {b}))) > 0"""


def _walk(i: str, j: str, donor: str, acceptor: str) -> str:
    """Rungs in a row from a rung, k = 0 included; ``i``, ``j`` and the closing bond as functions of k."""
    return f"""(SELECT min(k) FROM (SELECT unnest(range(22)) AS k) WHERE NOT (
      EXISTS (SELECT 1 FROM b y WHERE y.chain = x.chain AND y.donor = {i} AND y.acceptor = {j})
      AND EXISTS (SELECT 1 FROM b y WHERE y.chain = x.chain AND y.donor = {donor} AND y.acceptor = {acceptor})))"""


def _bond(donor: str, acceptor: str) -> str:
    return f"CAST(EXISTS (SELECT 1 FROM b y WHERE y.chain = x.chain AND y.donor = {donor} AND y.acceptor = {acceptor}) AS INTEGER)"


ORACLES["strand_ladders"] = f"""WITH RECURSIVE {BONDS},
b AS MATERIALIZED (SELECT DISTINCT job_id, chain, donor, acceptor FROM bonds),
walks AS MATERIALIZED (
  SELECT x.*, row_number() OVER (PARTITION BY chain ORDER BY donor, acceptor) AS nr,
    {_walk('x.donor + 2*k', 'x.acceptor - 2*k', 'x.acceptor - 2*k', 'x.donor + 2*k')} AS au,
    {_walk('x.donor - 2*k', 'x.acceptor + 2*k', 'x.acceptor + 2*k', 'x.donor - 2*k')} AS ad,
    {_walk('x.donor + 2*k', 'x.acceptor + 2*k', 'x.acceptor + 2*k + 2', 'x.donor + 2*k')} AS pu,
    {_walk('x.donor - 2*k', 'x.acceptor - 2*k', 'x.acceptor - 2*k + 2', 'x.donor - 2*k')} AS pd FROM b x),
ends AS MATERIALIZED (
  SELECT job_id, chain, donor, acceptor, nr,
    CASE WHEN au > 0 THEN 2*(ad-1) + {_bond('x.acceptor + 2*ad', 'x.donor - 2*ad')} END AS below,
    CASE WHEN au > 0 THEN 2*(au-1) + {_bond('x.donor + 2*au', 'x.acceptor - 2*au')} END AS above,
    CASE WHEN pu > 0 THEN 2*(pd-1) + {_bond('x.acceptor + 1 - 2*(pd-1) - 1', 'x.donor - 2*pd')} END AS p_below,
    CASE WHEN pu > 0 THEN 2*(pu-1) + {_bond('x.donor + 2*pu', 'x.acceptor + 1 + 2*(pu-1) + 1')} END AS p_above FROM walks x),
offers AS (
  SELECT job_id, chain, donor, acceptor, nr,
    CASE WHEN below + above >= 1 THEN CASE WHEN donor - below < acceptor + below THEN {{s1: donor - below, s2: acceptor + below, d: -1, n: below + above + 1}}
      ELSE {{s1: acceptor - above, s2: donor + above, d: -1, n: below + above + 1}} END
    WHEN p_below + p_above >= 1 THEN {{s1: least(donor, acceptor + 1) - p_below, s2: greatest(donor, acceptor + 1) - p_below, d: 1, n: p_below + p_above + 1}} END AS offer
  FROM ends),
scan AS (
  SELECT DISTINCT job_id, chain, CAST(0 AS BIGINT) AS nr, list_filter([offer], lambda p: false) AS acc FROM offers
  UNION ALL
  SELECT o.job_id, o.chain, o.nr, CASE WHEN offer IS NULL OR {_ALIGNED.format(a='donor', b='acceptor')} OR {_ALIGNED.format(a='donor', b='acceptor + 1')}
    THEN acc ELSE list_append(acc, offer) END
  FROM scan s JOIN offers o ON o.chain = s.chain AND o.nr = s.nr + 1),
final AS (SELECT job_id, chain, unnest(arg_max(acc, nr)) AS p FROM scan GROUP BY job_id, chain)
SELECT job_id, chain, CAST(p.s1 AS INTEGER) AS start1, CAST(p.s2 AS INTEGER) AS start2, CAST(p.d AS INTEGER) AS direction, CAST(p.n AS INTEGER) AS length FROM final"""

# Sheets by walking: one step of the recursion adds a ladder to either end of the open sheet, or begins the next one.
ORACLES["beta_sheets"] = ORACLES["strand_ladders"].rsplit("\nSELECT", 1)[0] + f""",
ladders AS MATERIALIZED (
  SELECT job_id, chain, p.s1 AS s1, p.s2 AS s2, p.d AS d, p.n AS n, row_number() OVER (PARTITION BY chain ORDER BY p.s1, p.s2, p.d, p.n) AS pair FROM final),
sides AS (
  SELECT chain, pair, t AS turned, CASE t WHEN 0 THEN s1 + k ELSE s2 + d*k END AS near, CASE t WHEN 0 THEN s2 + d*k ELSE s1 + k END AS far
  FROM (SELECT *, unnest(range(n)) AS k FROM ladders), (VALUES (0), (1)) v(t)),
follows AS MATERIALIZED (
  SELECT DISTINCT a.chain, a.pair AS pair1, a.turned AS turned1, b.pair AS pair2, b.turned AS turned2
  FROM sides a JOIN sides b ON a.chain = b.chain AND a.far = b.near AND a.pair <> b.pair
  JOIN pts p1 ON p1.chain = a.chain AND p1.res_idx = a.near JOIN pts p2 ON p2.chain = a.chain AND p2.res_idx = a.far
  JOIN pts p3 ON p3.chain = a.chain AND p3.res_idx = b.far
  WHERE (p2.x-p1.x)*(p3.x-p2.x) + (p2.y-p1.y)*(p3.y-p2.y) + (p2.z-p1.z)*(p3.z-p2.z) > 0),
walk AS (
  SELECT DISTINCT job_id, chain, 0 AS step, 0 AS sheet, [{{q: CAST(1 AS BIGINT), t: 0}}] AS row_, [CAST(1 AS BIGINT)] AS placed, false AS over FROM ladders
  UNION ALL
  SELECT job_id, chain, step + 1, CASE WHEN ended THEN sheet + 1 ELSE sheet END,
    CASE WHEN ended THEN [{{q: fresh, t: 0}}] ELSE list_concat(list_concat(CASE WHEN l IS NULL THEN [] ELSE [l] END, row_), CASE WHEN r IS NULL THEN [] ELSE [r] END) END,
    list_concat(placed, CASE WHEN ended THEN [fresh] ELSE list_filter([l.q, r.q], lambda q: q IS NOT NULL) END), false
  FROM (SELECT *, l IS NULL AND r IS NULL AS ended,
      (SELECT min(pair) FROM ladders n WHERE n.chain = x.chain AND NOT list_contains(x.placed, n.pair)) AS fresh
    FROM (SELECT y.*, (SELECT arg_min({{q: pair2, t: turned2}}, pair2*2 + turned2) FROM follows f WHERE f.chain = y.chain AND f.pair1 = row_[-1].q
            AND f.turned1 = row_[-1].t AND NOT list_contains(list_transform(row_, lambda w: w.q), f.pair2) AND (l IS NULL OR f.pair2 <> l.q)) AS r
      FROM (SELECT s.*, (SELECT arg_min({{q: pair2, t: 1 - turned2}}, pair2*2 + turned2) FROM follows f WHERE f.chain = s.chain AND f.pair1 = row_[1].q
              AND f.turned1 = 1 - row_[1].t AND NOT list_contains(list_transform(row_, lambda w: w.q), f.pair2)) AS l FROM walk s) y) x)
  WHERE NOT ended OR fresh IS NOT NULL),
whole AS (SELECT job_id, chain, sheet, arg_max(row_, step) AS row_ FROM walk GROUP BY job_id, chain, sheet),
cells AS (SELECT job_id, chain, sheet, unnest(row_) AS w, unnest(range(len(row_))) AS ord FROM whole)
SELECT c.job_id, c.chain, c.sheet, CAST(ord AS INTEGER) AS ord,
  CAST(CASE WHEN w.t = 0 THEN s1 WHEN d < 0 THEN s2 - n + 1 ELSE s2 END AS INTEGER) AS start1,
  CAST(CASE WHEN w.t = 0 THEN s2 WHEN d < 0 THEN s1 + n - 1 ELSE s1 END AS INTEGER) AS start2, CAST(d AS INTEGER) AS direction, CAST(n AS INTEGER) AS length
FROM cells c JOIN ladders l ON l.chain = c.chain AND l.pair = w.q"""

_LADDERS = ORACLES["strand_ladders"].rsplit("\nSELECT", 1)[0] + f""",
names AS (SELECT * FROM (VALUES {', '.join(f"('{letter}', '{name}')" for name, letter in RESIDUES[:20])}) t(letter, res_name)),
ladders AS (
  SELECT job_id, chain, p.s1 AS s1, p.s2 AS s2, p.d AS d, p.n AS n, row_number() OVER (PARTITION BY chain ORDER BY p.s1, p.s2, p.d, p.n) AS sheet FROM final),
named AS (SELECT chain, res_idx, res_name || ' A' || lpad(CAST(res_idx + 1 AS VARCHAR), 4, ' ') || ' ' AS t FROM pts JOIN names USING (letter))"""


def _strand(strand: int, sense: str, first: str, last: str, ties: str) -> str:
    tail = f"""'  O  ' || c.t || '  N  ' || p.t""" if ties else "''"
    joins = f"JOIN named c ON c.chain = l.chain AND c.res_idx = s2 + d*(n // 2) JOIN named p ON p.chain = l.chain AND p.res_idx = s1 + n // 2 + CASE WHEN d > 0 THEN 1 ELSE 0 END" if ties else ""
    return f"""
SELECT l.job_id, l.chain, CAST(2*sheet - {2 - strand} AS INTEGER) AS ord, rpad('SHEET    {strand} ' || lpad(CAST(sheet AS VARCHAR), 3, ' ') || ' 2 ' || a.t || ' ' || b.t
  || lpad(CAST({sense} AS VARCHAR), 2, ' ') || {tail}, 80, ' ') AS line
FROM ladders l JOIN named a ON a.chain = l.chain AND a.res_idx = {first} JOIN named b ON b.chain = l.chain AND b.res_idx = {last} {joins}"""


ORACLES["sheet_records"] = _LADDERS + _strand(1, "0", "s1", "s1 + n - 1", "") + "\nUNION ALL" + _strand(
    2, "d", "CASE WHEN d < 0 THEN s2 - n + 1 ELSE s2 END", "CASE WHEN d < 0 THEN s2 ELSE s2 + n - 1 END", "yes")
ORACLES["sheet_registration"] = _LADDERS + """
SELECT job_id || '/' || chain AS path, 0 AS model_ord, 'A' AS chain_id, CAST(sheet AS VARCHAR) AS sheet_id, 2 AS strand, CAST(s1 AS INTEGER) AS start1,
  CAST(s2 AS INTEGER) AS start2, CAST(d AS INTEGER) AS direction, CAST(n AS INTEGER) AS length FROM ladders"""

ORACLES["hinge_edges_between_matches"] = SEARCH.split(",\nedges AS MATERIALIZED")[0] + """
SELECT h.g AS grp, concat_ws('-', a.p1, a.p2, a.len) AS "before", concat_ws('-', b.p1, b.p2, b.len) AS "after",
  round(half_cosine, 4) AS half_cosine, round(displacement, 4) AS displacement,
  round(-ln((1 - cos(greatest(2*acos(least(half_cosine, 1)), 0.1e0)))/2) + 4 - displacement, 4) AS bonus
FROM hinges h JOIN cand a ON a.g = h.g AND a.id = h.before JOIN cand b ON b.g = h.g AND b.id = h.after
WHERE a.score >= 1.6 AND b.score >= 1.6 AND half_cosine >= cos(pi()/8) AND displacement <= 5"""

ORACLES["helix_records"] = ORACLES["helix_runs"].rsplit("\nSELECT", 1)[0] + f""",
names AS (SELECT * FROM (VALUES {', '.join(f"('{letter}', '{name}')" for name, letter in RESIDUES[:20])}) t(letter, res_name)),
named AS (SELECT chain, res_idx, res_name || ' A ' || lpad(CAST(res_idx + 1 AS VARCHAR), 4, ' ') || ' ' AS t FROM pts JOIN names USING (letter)),
kinds AS (SELECT job_id, chain, i AS start, length, CASE step WHEN 4 THEN 1 WHEN 3 THEN 5 ELSE 3 END AS class FROM scan WHERE length IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY start, class) AS nr FROM kinds)
SELECT h.job_id, h.chain, CAST(nr AS INTEGER) AS ord, 'HELIX  ' || lpad(CAST(nr AS VARCHAR), 3, ' ') || ' ' || lpad(CAST(nr AS VARCHAR), 3, ' ') || ' ' || a.t || ' '
  || b.t || lpad(CAST(class AS VARCHAR), 2, ' ') || repeat(' ', 31) || lpad(CAST(length AS VARCHAR), 5, ' ') AS line
FROM numbered h JOIN named a ON a.chain = h.chain AND a.res_idx = start JOIN named b ON b.chain = h.chain AND b.res_idx = start + length - 1"""
