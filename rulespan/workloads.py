"""Queries over the test tables, each as a program of the rule language and as SQL for comparison.

An entry is name -> (rules and facts, goal, SQL, digits that doubles are rounded to). Tables
are stored relations under their own names, with columns in file order and times in epoch
milliseconds.
"""

from __future__ import annotations

import re

LI = "lineitem(O, P, S, N, Q, E, D, T, F, L, W)"

#: name -> (program, goal, sql, digits)
WORKLOADS: dict[str, tuple[str, str, str, int]] = {
    # --- scan, projection, filters
    "scan_project": ("", "?customer(K, Name, _, B, _)", 'SELECT c_custkey AS k, c_name AS name, c_nationkey AS _p2, c_acctbal AS b, c_mktsegment AS _p4 FROM customer', 4),
    "project_distinct": ("seg(S) <- customer(_, _, _, _, S)", "?seg(S)", "SELECT DISTINCT c_mktsegment AS s FROM customer", 4),
    "head_constants": ("r(K, 1, V) <- nation(K, _, R), V = K * 10 + R", "?r(K, One, V)", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(1 AS BIGINT) AS one, CAST(n_nationkey * 10 + n_regionkey AS BIGINT) AS v FROM nation", 4),
    "filter_int": ("", "?part(P, _, _, _, S, _), S >= 40, S != 45", "SELECT p_partkey AS p, p_name AS _p1, p_brand AS _p2, p_type AS _p3, CAST(p_size AS BIGINT) AS s, p_retailprice AS _p5 FROM part WHERE p_size >= 40 AND p_size <> 45", 4),
    "filter_string": ('big(K, S) <- customer(K, _, _, _, S), S > "B", S <= "FURNITURE", S != "BUILDING"', "?big(K, S)", "SELECT c_custkey AS k, c_mktsegment AS s FROM customer WHERE c_mktsegment > 'B' AND c_mktsegment <= 'FURNITURE' AND c_mktsegment <> 'BUILDING'", 4),
    "filter_bool_or_union": ('pick(K) <- customer(K, _, _, B, _), B < 0.0\npick(K) <- customer(K, _, _, _, "HOUSEHOLD")', "?pick(K)", "SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'HOUSEHOLD'", 4),
    "filter_float_tol": ("d(O, N) <- lineitem(O, _, _, N, _, _, 0.05, _, _, _, _)", "?d(O, N)", "SELECT DISTINCT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE abs(l_discount - 0.05) < 1e-10", 4),
    "filter_arith": ("r(P, S) <- part(P, _, _, _, S, R), R > S * 30 + 100, P % 7 = 3", "?r(P, S)", "SELECT p_partkey AS p, CAST(p_size AS BIGINT) AS s FROM part WHERE p_retailprice > p_size * 30 + 100 AND p_partkey % 7 = 3", 4),
    "repeated_var": ("", "?lineitem(K, K, S, N, Q, E, D, T, F, L, W)", "SELECT l_orderkey AS k, l_orderkey AS k_, l_suppkey AS s, CAST(l_linenumber AS BIGINT) AS n, l_quantity AS q, l_extendedprice AS e, l_discount AS d, l_tax AS t, l_returnflag AS f, l_linestatus AS l, (epoch_us(l_shipdate) // 1000) AS w FROM lineitem WHERE l_orderkey = l_partkey", 4),
    "alias_binding": ('r(K, B, C) <- nation(K, _, A), B = A, C = "fixed"', "?r(K, B, C)", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS b, 'fixed' AS c FROM nation", 4),
    # --- joins
    "join_two": ("r(N, R) <- nation(_, N, K), region(K, R)", "?r(N, R)", "SELECT DISTINCT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey", 4),
    "join_three_filter_arith": ('r(O, C, V) <- orders(O, C, _, T, _, _), customer(C, _, N, _, "BUILDING"), nation(N, _, G), T > 100000.0, V = G * 1000 + N', "?r(O, C, V)", "SELECT DISTINCT o_orderkey AS o, o_custkey AS c, CAST(n_regionkey * 1000 + n_nationkey AS BIGINT) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 100000", 4),
    "join_star": ("r(G, RN, sum<X>) <- lineitem(O, _, _, _, _, E, D, _, G, _, _), orders(O, C, _, _, _, _), customer(C, _, N, _, _), nation(N, _, R), region(R, RN), X = E * (1 - D)", "?r(G, R, X)", "SELECT l_returnflag AS g, r_name AS r, round(sum(l_extendedprice * (1 - l_discount)), 1) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2", 1),
    "join_self": ("r(A, B) <- nation(A, _, R), nation(B, _, R), A < B", "?r(A, B)", "SELECT CAST(x.n_nationkey AS BIGINT) AS a, CAST(y.n_nationkey AS BIGINT) AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey", 4),
    "join_theta": ("r(S, P) <- supplier(S, _, _, B), part(P, _, _, _, Z, R), B < R - 1200, Z < 5", "?r(S, P)", "SELECT s_suppkey AS s, p_partkey AS p FROM supplier JOIN part ON s_acctbal < p_retailprice - 1200 AND p_size < 5", 4),
    "join_cross": ("r(A, B) <- region(A, _), nation(B, _, _)", "?r(A, B)", "SELECT CAST(r_regionkey AS BIGINT) AS a, CAST(n_nationkey AS BIGINT) AS b FROM region, nation", 4),
    "join_bridge_arith": ("r(A, B) <- orders(A, C, _, _, _, _), P = C - 1, customer(P, B, _, _, _)", "?r(A, B)", "SELECT DISTINCT o_orderkey AS a, c_name AS b FROM orders JOIN customer ON c_custkey = o_custkey - 1", 4),
    "semi_join": ("r(C, N) <- customer(C, N, _, _, _), orders(_, C, \"F\", _, _, _)", "?r(C, N)", "SELECT c_custkey AS c, c_name AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", 4),
    "anti_join": ("r(C) <- customer(C, _, _, _, _), !orders(_, C, _, _, _, _)", "?r(C)", "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", 4),
    "anti_join_const": ('r(C) <- customer(C, _, _, _, _), !orders(_, C, "F", _, _, _)', "?r(C)", "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", 4),
    "outer_sim": ("has(C, O) <- orders(O, C, _, _, _, _)\nr(C, O) <- customer(C, _, _, _, _), has(C, O)\nr(C, -1) <- customer(C, _, _, _, _), !has(C, _)", "?r(C, O)", "SELECT c_custkey AS c, coalesce(o_orderkey, -1) AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey", 4),
    "interval_join": ("r(A, B) <- events(A, T, U, \"purchase\", _, _), events(B, V, U, \"click\", _, _), D = time_diff(T, V), D >= 0, D <= 600000", "?r(A, B)", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'click' AND (epoch_us(a.ts) // 1000) - (epoch_us(b.ts) // 1000) BETWEEN 0 AND 600000", 4),
    # --- aggregates
    "agg_count": ("r(F, count<O>) <- " + LI, "?r(F, N)", "SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1", 4),
    "agg_count_distinct": ("r(F, count_distinct<O>) <- " + LI, "?r(F, N)", "SELECT l_returnflag AS f, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1", 4),
    "agg_sum": ("r(F, L, sum<Q>) <- " + LI, "?r(F, L, X)", "SELECT l_returnflag AS f, l_linestatus AS l, round(sum(l_quantity), 2) AS x FROM lineitem GROUP BY 1, 2", 2),
    "agg_min_max": ("r(F, min<W>, max<E>, min<S>) <- " + LI, "?r(F, A, B, C)", "SELECT l_returnflag AS f, min((epoch_us(l_shipdate) // 1000)) AS a, max(l_extendedprice) AS b, min(l_suppkey) AS c FROM lineitem GROUP BY 1", 4),
    "agg_avg": ("r(F, avg<Q>, avg<S>) <- " + LI, "?r(F, A, B)", "SELECT l_returnflag AS f, round(avg(l_quantity), 4) AS a, round(avg(l_suppkey), 4) AS b FROM lineitem GROUP BY 1", 4),
    "agg_multi": ("r(F, L, sum<Q>, sum<E>, sum<X>, avg<D>, count<O>) <- " + LI + ", W <= 904608000000, X = E * (1 - D)", "?r(F, L, A, B, C, D, N)", "SELECT l_returnflag AS f, l_linestatus AS l, round(sum(l_quantity), 1) AS a, round(sum(l_extendedprice), 1) AS b, round(sum(l_extendedprice * (1 - l_discount)), 1) AS c, round(avg(l_discount), 1) AS d, count(*) AS n FROM lineitem WHERE (epoch_us(l_shipdate) // 1000) <= 904608000000 GROUP BY 1, 2", 1),
    "agg_global": ("r(count<O>, sum<N>, max<Q>) <- " + LI, "?r(A, B, C)", "SELECT count(*) AS a, CAST(sum(l_linenumber) AS BIGINT) AS b, max(l_quantity) AS c FROM lineitem HAVING count(*) > 0", 4),
    "agg_global_empty": ('r(count<K>, sum<B>) <- customer(K, _, _, B, "NOTHING")', "?r(N, B)", "SELECT count(*) AS n, sum(c_acctbal) AS b FROM customer WHERE c_mktsegment = 'NOTHING' HAVING count(*) > 0", 2),
    "agg_having": ("t(C, count<O>, sum<T>) <- orders(O, C, _, T, _, _)\nr(C, N, S) <- t(C, N, S), N > 15, S > 1000000.0", "?r(C, N, S)", "SELECT o_custkey AS c, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1 HAVING count(*) > 15 AND sum(o_totalprice) > 1000000", 2),
    "agg_grouping_sets_sim": ("a(F, L, count<O>) <- " + LI + '\nb(F, count<O>) <- ' + LI + '\nr(F, L, N) <- a(F, L, N)\nr(F, "all", N) <- b(F, N)', "?r(F, L, N)", "SELECT l_returnflag AS f, l_linestatus AS l, count(*) AS n FROM lineitem GROUP BY 1, 2 UNION SELECT l_returnflag, 'all', count(*) FROM lineitem GROUP BY 1", 4),
    "topk_global": ("r(top_k<10, O, C, T:desc>) <- orders(O, C, _, T, _, _)", "?r(O, C, T)", "SELECT o_orderkey AS o, o_custkey AS c, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, o_orderkey, o_custkey LIMIT 10", 4),
    "topk_grouped": ("r(S, top_k<3, K, B:desc>) <- customer(K, _, _, B, S)", "?r(S, K, B)", "SELECT c_mktsegment AS s, c_custkey AS k, c_acctbal AS b FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3", 4),
    "topk_ascending": ("r(N, top_k<2, S, B:asc>) <- supplier(S, _, N, B)", "?r(N, S, B)", "SELECT CAST(s_nationkey AS BIGINT) AS n, s_suppkey AS s, s_acctbal AS b FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) <= 2", 4),
    "topk_threshold": ("r(S, top_k_threshold<5, 9000, K, B:desc>) <- customer(K, _, _, B, S)", "?r(S, K, B)", "SELECT c_mktsegment AS s, c_custkey AS k, c_acctbal AS b FROM customer WHERE c_acctbal >= 9000 QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 5", 4),
    "within_radius": ("r(within_radius<0.02, O, N, D:asc>) <- lineitem(O, _, _, N, _, _, D, _, _, _, _)", "?r(O, N, D)", "SELECT DISTINCT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS n, l_discount AS d FROM lineitem WHERE l_discount <= 0.02", 4),
    "order_limit_offset": ("", "?orders(O, _, _, T:desc, _, _), limit(20, 5)", "SELECT o_orderkey AS o, o_custkey AS _p1, o_orderstatus AS _p2, o_totalprice AS t, (epoch_us(o_orderdate) // 1000) AS _p4, o_orderpriority AS _p5 FROM orders ORDER BY o_totalprice DESC LIMIT 20 OFFSET 5", 4),
    # --- sets
    "union_distinct": ("r(N) <- customer(_, _, N, _, _)\nr(N) <- supplier(_, _, N, _)", "?r(N)", "SELECT CAST(c_nationkey AS BIGINT) AS n FROM customer UNION SELECT s_nationkey FROM supplier", 4),
    "intersect": ("a(N) <- customer(_, _, N, B, _), B > 9900.0\nb(N) <- supplier(_, _, N, _)\nr(N) <- a(N), b(N)", "?r(N)", "SELECT CAST(c_nationkey AS BIGINT) AS n FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier", 4),
    "except": ("a(N) <- nation(N, _, _)\nb(N) <- customer(_, _, N, B, _), B > 9900.0\nr(N) <- a(N), !b(N)", "?r(N)", "SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900", 4),
    "symmetric_diff": ("a(N) <- customer(_, _, N, B, _), B > 9900.0\nb(N) <- supplier(_, _, N, B), B > 5000.0\nr(N) <- a(N), !b(N)\nr(N) <- b(N), !a(N)", "?r(N)", "WITH a AS (SELECT DISTINCT c_nationkey n FROM customer WHERE c_acctbal > 9900), b AS (SELECT DISTINCT s_nationkey n FROM supplier WHERE s_acctbal > 5000) SELECT CAST(n AS BIGINT) AS n FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a))", 4),
    "universal_quant": ('status(S) <- orders(_, _, S, _, _, _)\nhas(C, S) <- orders(_, C, S, _, _, _)\nmiss(C) <- has(C, _), status(S), !has(C, S)\nr(C) <- has(C, _), !miss(C)', "?r(C)", "SELECT o_custkey AS c FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = (SELECT count(DISTINCT o_orderstatus) FROM orders)", 4),
    "subset_check": ("a(N) <- supplier(_, _, N, _)\nb(N) <- customer(_, _, N, _, _)\nout(N) <- a(N), !b(N)\nr(count<N>) <- out(N)", "?r(N)", "SELECT count(*) AS n FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer) HAVING count(*) > 0", 4),
    # --- what windows do elsewhere
    "rank_sim": ("s(N, sum<B>) <- supplier(_, _, N, B)\nr(N, count<M>) <- s(N, A), s(M, B), B > A", "?r(N, R)", "WITH s AS (SELECT s_nationkey n, sum(s_acctbal) b FROM supplier GROUP BY 1) SELECT CAST(x.n AS BIGINT) AS n, count(*) AS r FROM s x JOIN s y ON y.b > x.b GROUP BY 1", 4),
    "dense_rank_sim": ("z(S) <- part(_, _, _, _, S, _)\nr(S, count<T>) <- z(S), z(T), T >= S", "?r(S, R)", "SELECT CAST(p_size AS BIGINT) AS s, dense_rank() OVER (ORDER BY p_size DESC) AS r FROM (SELECT DISTINCT p_size FROM part)", 4),
    "ntile_sim": ("n(count<K>) <- nation(K, _, _)\nr(K, T) <- nation(K, _, _), n(N), T = floor(Q), Q = K * 4 / N", "?r(K, T)", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(floor(n_nationkey * 4 / (SELECT count(*) FROM nation)) AS BIGINT) AS t FROM nation", 4),
    "lag_lead": ("r(K, A, B) <- supplier(K, _, _, B), P = K - 1, supplier(P, _, _, A)", "?r(K, A, B)", "SELECT * FROM (SELECT s_suppkey AS k, lag(s_acctbal) OVER (ORDER BY s_suppkey) AS a, s_acctbal AS b FROM supplier) WHERE a IS NOT NULL", 4),
    "running_total": ("r(K, sum<B>) <- supplier(K, _, _, _), supplier(J, _, _, B), J <= K", "?r(K, X)", "SELECT s_suppkey AS k, round(sum(s_acctbal) OVER (ORDER BY s_suppkey), 2) AS x FROM supplier", 2),
    "moving_average": ("r(K, avg<B>) <- supplier(K, _, _, _), L = K - 2, supplier(J, _, _, B), J >= L, J <= K", "?r(K, X)", "SELECT s_suppkey AS k, round(avg(s_acctbal) OVER (ORDER BY s_suppkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS x FROM supplier", 4),
    "first_last_value": ("f(U, min<T>, max<T>) <- events(_, T, U, _, _, _)\nr(U, A, B) <- f(U, S, E), events(A, S, U, _, _, _), events(B, E, U, _, _, _)", "?r(U, A, B)", "WITH f AS (SELECT user_id u, min(ts) s, max(ts) e FROM events GROUP BY 1) SELECT u, a.event_id AS a, b.event_id AS b FROM f JOIN events a ON a.user_id = u AND a.ts = s JOIN events b ON b.user_id = u AND b.ts = e", 4),
    "gap_detection": ('k(C) <- orders(_, C, _, _, _, _)\nr(C) <- k(C), D = C + 1, customer(D, _, _, _, _), !k(D)', "?r(C)", "SELECT DISTINCT o_custkey AS c FROM orders WHERE o_custkey + 1 IN (SELECT c_custkey FROM customer) AND o_custkey + 1 NOT IN (SELECT o_custkey FROM orders)", 4),
    "row_number_sim": ("r(G, K, count<J>) <- nation(K, _, G), nation(J, _, G), J <= K", "?r(G, K, N)", "SELECT CAST(n_regionkey AS BIGINT) AS g, CAST(n_nationkey AS BIGINT) AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n FROM nation", 4),
    "gap_ends": ('k(C) <- orders(_, C, "P", _, _, _)\nr(C) <- k(C), D = C + 1, customer(D, _, _, _, _), !k(D)', "?r(C)", "WITH k AS (SELECT DISTINCT o_custkey c FROM orders WHERE o_orderstatus = 'P') SELECT c FROM k WHERE c + 1 IN (SELECT c_custkey FROM customer) AND c + 1 NOT IN (SELECT c FROM k)", 4),
    "island_detection": ('k(C) <- orders(_, C, "P", _, _, _)\ns(C) <- k(C), P = C - 1, !k(P)\ne(C) <- k(C), N = C + 1, !k(N)\nr(A, min<B>) <- s(A), e(B), B >= A', "?r(A, B)", "SELECT min(c) AS a, max(c) AS b FROM (SELECT c, c - row_number() OVER (ORDER BY c) g FROM (SELECT DISTINCT o_custkey c FROM orders WHERE o_orderstatus = 'P')) GROUP BY g", 4),
    "percentile_bucket": ('r(K, "low") <- customer(K, _, _, B, _), B < 1000.0\nr(K, "medium") <- customer(K, _, _, B, _), B >= 1000.0, B < 8000.0\nr(K, "high") <- customer(K, _, _, B, _), B >= 8000.0', "?r(K, Bucket)", "SELECT c_custkey AS k, CASE WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 8000 THEN 'medium' ELSE 'high' END AS bucket FROM customer", 4),
    "set_containment": ('big(C) <- customer(C, _, _, B, _), B > 0.0\nopen(C) <- orders(_, C, "P", _, _, _)\nr(C) <- open(C), !big(C)', "?r(C)", "SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", 4),
    "anti_join_open": ('r(C) <- customer(C, _, _, _, _), !orders(_, C, "P", _, _, _)', "?r(C)", "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", 4),
    "percent_of_total": ("t(sum<B>) <- supplier(_, _, _, B)\nn(N, sum<B>) <- supplier(_, _, N, B)\nr(N, P) <- n(N, S), t(T), P = 100 * S / T", "?r(N, P)", "SELECT CAST(s_nationkey AS BIGINT) AS n, round(100 * sum(s_acctbal) / (SELECT sum(s_acctbal) FROM supplier), 4) AS p FROM supplier GROUP BY 1", 4),
    # --- functions
    "arith_ops": ("r(K, A, B, C, D, E) <- nation(K, _, R), A = K + R * 2, B = K - 30, C = K / R, D = K % R, E = B % 7", "?r(K, A, B, C, D, E)", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey + n_regionkey * 2 AS BIGINT) AS a, CAST(n_nationkey - 30 AS BIGINT) AS b, round(n_nationkey / nullif(n_regionkey, 0), 4) AS c, CAST(n_nationkey % nullif(n_regionkey, 0) AS BIGINT) AS d, CAST((n_nationkey - 30) % 7 AS BIGINT) AS e FROM nation", 4),
    "math_fns": ("r(K, A, B, C, D, E, F, G, H, I, J) <- customer(K, _, _, B0, _), X = B0 / 1000, A = abs(B0), B = sqrt(B0), C = pow(X, 2), D = log(B0), E = exp(X), F = sin(X), G = cos(X), H = floor(B0), I = ceil(B0), J = sign(B0)", "?r(K, A, B, C, D, E, F, G, H, I, J)", "SELECT c_custkey AS k, round(abs(c_acctbal), 2) AS a, round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 2) AS b, round(pow(c_acctbal / 1000, 2), 2) AS c, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 2) AS d, round(exp(c_acctbal / 1000), 2) AS e, round(sin(c_acctbal / 1000), 2) AS f, round(cos(c_acctbal / 1000), 2) AS g, CAST(floor(c_acctbal) AS BIGINT) AS h, CAST(ceil(c_acctbal) AS BIGINT) AS i, CAST(sign(c_acctbal) AS BIGINT) AS j FROM customer", 2),
    "math_more": ("r(K, A, B, C) <- nation(K, _, R), A = tan(K), M = R - 2, B = abs_int64(M), C = abs_float64(M)", "?r(K, A, B, C)", "SELECT CAST(n_nationkey AS BIGINT) AS k, round(tan(n_nationkey), 4) AS a, CAST(abs(n_regionkey - 2) AS BIGINT) AS b, CAST(abs(n_regionkey - 2) AS DOUBLE) AS c FROM nation", 4),
    "string_fns": ("r(K, A, B, C, D, E, F) <- customer(K, N, _, _, S), A = len(N), B = upper(N), C = lower(S), D = substr(N, 0, 4), E = replace(S, \"O\", \"0\"), T = concat(\"  \", S, \" \"), F = trim(T)", "?r(K, A, B, C, D, E, F)", "SELECT c_custkey AS k, CAST(octet_length(encode(c_name)) AS BIGINT) AS a, upper(c_name) AS b, lower(c_mktsegment) AS c, substr(c_name, 1, 4) AS d, replace(c_mktsegment, 'O', '0') AS e, c_mktsegment AS f FROM customer", 4),
    "concat_mixed": ('r(K, A) <- nation(K, N, R), H = K / 2, A = concat(N, "-", R, "-", H)', "?r(K, A)", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name || '-' || n_regionkey || '-' || CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey // 2 AS VARCHAR) ELSE CAST(n_nationkey / 2 AS VARCHAR) END AS a FROM nation", 4),
    "conv_fns": ("r(K, A, B, C) <- supplier(K, _, N, B0), A = to_int(B0), B = to_float(N), C = to_int(N)", "?r(K, A, B, C)", "SELECT s_suppkey AS k, CAST(trunc(s_acctbal) AS BIGINT) AS a, CAST(s_nationkey AS DOUBLE) AS b, CAST(s_nationkey AS BIGINT) AS c FROM supplier", 4),
    "minmax_val": ("r(K, A, B, C) <- nation(K, N, R), A = min_val(K, R), B = max_val(K, 7), C = max_val(N, \"NATION_3\")", "?r(K, A, B, C)", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(least(n_nationkey, n_regionkey) AS BIGINT) AS a, CAST(greatest(n_nationkey, 7) AS BIGINT) AS b, greatest(n_name, 'NATION_3') AS c FROM nation", 4),
    "time_fns": ("r(E, A, B, C, D, F, G) <- events(E, T, _, _, _, _), A = time_add(T, 60000), B = time_sub(T, 1000), C = time_diff(T, 1704067200000), D = time_before(T, 1704100000000), F = time_after(T, 1704100000000), G = time_between(T, 1704100000000, 1704200000000)", "?r(E, A, B, C, D, F, G)", "SELECT event_id AS e, (epoch_us(ts) // 1000) + 60000 AS a, (epoch_us(ts) // 1000) - 1000 AS b, (epoch_us(ts) // 1000) - 1704067200000 AS c, (epoch_us(ts) // 1000) < 1704100000000 AS d, (epoch_us(ts) // 1000) > 1704100000000 AS f, (epoch_us(ts) // 1000) BETWEEN 1704100000000 AND 1704200000000 AS g FROM events", 4),
    "time_decay": ("r(E, A, B, C) <- events(E, T, _, _, _, _), A = time_decay(T, 1704200000000, 3600000), B = time_decay_linear(T, 1704200000000, 86400000), C = within_last(T, 1704200000000, 43200000)", "?r(E, A, B, C)", "WITH e AS (SELECT event_id, 1704200000000 - (epoch_us(ts) // 1000) AS age FROM events) SELECT event_id AS e, round(CASE WHEN age <= 0 THEN 1 ELSE pow(0.5, age / 3600000) END, 4) AS a, round(CASE WHEN age <= 0 THEN 1 ELSE greatest(0, 1 - age / 86400000) END, 4) AS b, age BETWEEN 0 AND 43200000 AS c FROM e", 4),
    "interval_fns": ("r(E, A, B, C, D) <- events(E, T, _, _, _, _), U = time_add(T, 100000), A = intervals_overlap(T, U, 1704100000000, 1704150000000), B = interval_contains(1704100000000, 1704150000000, T, U), C = interval_duration(T, U), D = point_in_interval(T, 1704100000000, 1704150000000)", "?r(E, A, B, C, D)", "SELECT event_id AS e, (epoch_us(ts) // 1000) <= 1704150000000 AND 1704100000000 <= (epoch_us(ts) // 1000) + 100000 AS a, 1704100000000 <= (epoch_us(ts) // 1000) AND (epoch_us(ts) // 1000) + 100000 <= 1704150000000 AS b, CAST(100000 AS BIGINT) AS c, (epoch_us(ts) // 1000) BETWEEN 1704100000000 AND 1704150000000 AS d FROM events", 4),
    "session_duration": ("s(U, min<T>, max<T>) <- events(_, T, U, _, _, _)\nr(U, D) <- s(U, A, B), D = time_diff(B, A)", "?r(U, D)", "SELECT user_id AS u, max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000)) AS d FROM events GROUP BY 1", 4),
    "sequence_detection": ('r(U, A, B) <- events(A, T, U, "signup", _, _), events(B, V, U, "purchase", _, _), T < V', "?r(U, A, B)", "SELECT a.user_id AS u, a.event_id AS a, b.event_id AS b FROM events a JOIN events b USING (user_id) WHERE a.event_type = 'signup' AND b.event_type = 'purchase' AND (epoch_us(a.ts) // 1000) < (epoch_us(b.ts) // 1000)", 4),
    # --- vectors
    "vec_distances": ("r(I, J, A, B, C, D) <- embeddings(I, V, L), embeddings(J, W, L), I != J, M = I % 20, M = 0, A = euclidean(V, W), B = cosine(V, W), C = dot(V, W), D = manhattan(V, W)", "?r(I, J, A, B, C, D)", "SELECT x.vec_id AS i, y.vec_id AS j, round(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 4) AS a, round(1 - list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 4) AS b, round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 4) AS c, round(list_sum(list_transform(list_zip(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), lambda p: abs(p[1] - p[2]))), 4) AS d FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id AND x.vec_id % 20 = 0", 4),
    "vec_utils": ("r(I, N, A, B) <- embeddings(I, V, _), N = vec_dim(V), S = vec_scale(V, 2.0), U = vec_add(V, V), A = euclidean(S, U), M = normalize(V), B = dot(M, M)", "?r(I, N, A, B)", "SELECT vec_id AS i, CAST(len(embedding) AS BIGINT) AS n, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b FROM embeddings", 4),
    "quantize": ("r(I, S, D) <- embeddings(I, V, _), Q = quantize_linear(V), Y = quantize_symmetric(V), P = dequantize(Q), S = dot(P, P), D = dot_int8(Y, Y)", "?r(I, S, D)", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] v, list_min(embedding::DOUBLE[]) lo, list_max(embedding::DOUBLE[]) hi, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) m FROM embeddings), q AS (SELECT vec_id, list_transform(v, lambda x: round((x - lo) * (255.0::DOUBLE / (hi - lo)) - 128.0::DOUBLE)) a, list_transform(v, lambda x: round(x * (127.0::DOUBLE / m))) b FROM e) SELECT vec_id AS i, list_dot_product(a, a) AS s, list_dot_product(b, b) AS d FROM q", 2),
    "int8_distances": ("q(I, Y, L) <- embeddings(I, V, L), Y = quantize_symmetric(V)\nr(I, J, A, B, C) <- q(I, V, L), q(J, W, L), I != J, A = euclidean_int8(V, W), B = cosine_int8(V, W), C = manhattan_int8(V, W)", "?r(I, J, A, B, C)", "WITH e AS (SELECT vec_id i, label l, embedding::DOUBLE[] v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) m FROM embeddings), q AS (SELECT i, l, list_transform(v, lambda x: round(x * (127.0::DOUBLE / m))) y FROM e) SELECT a.i AS i, b.i AS j, round(list_distance(a.y, b.y), 4) AS a, round(1 - list_cosine_similarity(a.y, b.y), 4) AS b, list_sum(list_transform(list_zip(a.y, b.y), lambda p: abs(p[1] - p[2]))) AS c FROM q a JOIN q b ON a.l = b.l AND a.i <> b.i", 4),
    "vec_threshold": ("q(V) <- embeddings(7, V, _)\nr(I, D) <- q(V), embeddings(I, W, _), D = cosine(V, W), D < 0.9", "?r(I, D)", "SELECT y.vec_id AS i, round(1 - list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 4) AS d FROM embeddings x, embeddings y WHERE x.vec_id = 7 AND 1 - list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) < 0.9", 4),
    "knn": ("q(I, V) <- embeddings(I, V, _), M = I % 20, M = 0\nr(I, top_k<5, J, D:asc>) <- q(I, V), embeddings(J, W, _), I != J, D = euclidean(V, W)", "?r(I, J, D)", "SELECT x.vec_id AS i, y.vec_id AS j, round(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 4) AS d FROM embeddings x JOIN embeddings y ON x.vec_id % 20 = 0 AND x.vec_id <> y.vec_id QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), y.vec_id) <= 5", 4),
    "lsh_self_consistency": ("b(I, B) <- embeddings(I, V, _), B = lsh_bucket(V, 3, 8)\nr(I, A, C) <- embeddings(I, V, _), b(I, B), S = vec_scale(V, 2.0), B2 = lsh_bucket(S, 3, 8), A = time_between(B, 0, 255), C = hamming(B, B2)", "?r(I, A, C)", "SELECT vec_id AS i, true AS a, CAST(0 AS BIGINT) AS c FROM embeddings", 4),
    "lsh_probes": ("r(I, N, M) <- embeddings(I, V, _), B = lsh_bucket(V, 1, 6), P = lsh_probes(B, 6, 10), N = vec_dim(P), Q = lsh_multi_probe(V, 1, 6, 64), M = vec_dim(Q)", "?r(I, N, M)", "SELECT vec_id AS i, CAST(10 AS BIGINT) AS n, CAST(42 AS BIGINT) AS m FROM embeddings", 4),
    # --- recursion
    "tc_full": ("edge(A, B) <- supplier(A, _, _, _), B = A * 2 + 1, supplier(B, _, _, _)\nedge(A, B) <- supplier(A, _, _, _), B = A + 10, supplier(B, _, _, _)\nreach(X, Y) <- edge(X, Y)\nreach(X, Z) <- reach(X, Y), edge(Y, Z)", "?reach(X, Y)", "WITH RECURSIVE e AS (SELECT s_suppkey a, s_suppkey * 2 + 1 b FROM supplier UNION SELECT s_suppkey, s_suppkey + 10 FROM supplier), edge AS (SELECT a, b FROM e WHERE b IN (SELECT s_suppkey FROM supplier)), reach(x, y) AS (SELECT a, b FROM edge UNION SELECT x, b FROM reach JOIN edge ON y = a) SELECT x, y FROM reach", 4),
    "tc_bound_magic": ("edge(A, B) <- part(A, _, _, _, _, _), B = A * 2 + 1, part(B, _, _, _, _, _)\nedge(A, B) <- part(A, _, _, _, _, _), B = A + 100, part(B, _, _, _, _, _)\nreach(X, Y) <- edge(X, Y)\nreach(X, Z) <- edge(X, Y), reach(Y, Z)", "?reach(1, Y)", "WITH RECURSIVE e AS (SELECT p_partkey a, p_partkey * 2 + 1 b FROM part UNION SELECT p_partkey, p_partkey + 100 FROM part), edge AS (SELECT a, b FROM e WHERE b IN (SELECT p_partkey FROM part)), reach(y) AS (SELECT b FROM edge WHERE a = 1 UNION SELECT b FROM reach JOIN edge ON y = a) SELECT CAST(1 AS BIGINT) AS _c0, y FROM reach", 4),
    "tc_bound_last": ("edge(A, B) <- part(A, _, _, _, _, _), B = A * 2 + 1, part(B, _, _, _, _, _)\nreach(X, Y) <- edge(X, Y)\nreach(X, Z) <- edge(X, Y), reach(Y, Z)", "?reach(X, 1023)", "WITH RECURSIVE edge AS (SELECT p_partkey a, p_partkey * 2 + 1 b FROM part WHERE p_partkey * 2 + 1 IN (SELECT p_partkey FROM part)), up(x) AS (SELECT a FROM edge WHERE b = 1023 UNION SELECT a FROM up JOIN edge ON b = x) SELECT x, CAST(1023 AS BIGINT) AS _c1 FROM up", 4),
    "tc_cyclic": ("edge(A, B) <- nation(A, _, _), B = A * 3 % 25\nedge(A, B) <- nation(A, _, _), C = A + 7, B = C % 25\nreach(X, Y) <- edge(X, Y)\nreach(X, Z) <- reach(X, Y), edge(Y, Z)", "?reach(X, Y)", "WITH RECURSIVE edge AS (SELECT CAST(n_nationkey AS BIGINT) a, CAST(n_nationkey * 3 % 25 AS BIGINT) b FROM nation UNION SELECT n_nationkey, (n_nationkey + 7) % 25 FROM nation), reach(x, y) AS (SELECT a, b FROM edge UNION SELECT x, b FROM reach JOIN edge ON y = a) SELECT x, y FROM reach", 4),
    "recursion_nonlinear": ("edge(A, B) <- supplier(A, _, _, _), B = A + 3, supplier(B, _, _, _)\nreach(X, Y) <- edge(X, Y)\nreach(X, Z) <- reach(X, Y), reach(Y, Z)", "?reach(X, Y)", "SELECT x.s_suppkey AS x, y.s_suppkey AS y FROM supplier x JOIN supplier y ON y.s_suppkey > x.s_suppkey AND (y.s_suppkey - x.s_suppkey) % 3 = 0", 4),
    "recursion_mutual": ("base(0)\nsucc(A, B) <- supplier(A, _, _, _), B = A + 1, supplier(B, _, _, _)\neven(X) <- base(X)\neven(Y) <- odd(X), succ(X, Y)\nodd(Y) <- even(X), succ(X, Y)\nr(X, \"even\") <- even(X)\nr(X, \"odd\") <- odd(X)", "?r(X, P)", "SELECT s_suppkey AS x, CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS p FROM supplier", 4),
    "recursion_min": ("edge(A, B) <- supplier(A, _, _, _), B = A * 2 + 1, supplier(B, _, _, _)\nedge(A, B) <- supplier(A, _, _, _), B = A + 10, supplier(B, _, _, _)\nd(Y, min<L>) <- edge(0, Y), L = 1\nd(Z, min<L>) <- d(Y, K), edge(Y, Z), L = K + 1", "?d(Y, L)", "WITH RECURSIVE e AS (SELECT s_suppkey a, s_suppkey * 2 + 1 b FROM supplier UNION SELECT s_suppkey, s_suppkey + 10 FROM supplier), edge AS (SELECT a, b FROM e WHERE b IN (SELECT s_suppkey FROM supplier)), walk(y, l) AS (SELECT b, CAST(1 AS BIGINT) FROM edge WHERE a = 0 UNION SELECT b, l + 1 FROM walk JOIN edge ON y = a) SELECT y, min(l) AS l FROM walk GROUP BY 1", 4),
    "recursion_with_negation": ("edge(A, B) <- supplier(A, _, _, _), B = A * 2 + 1, supplier(B, _, _, _)\nseen(Y) <- edge(1, Y)\nseen(Z) <- seen(Y), edge(Y, Z)\nr(X) <- supplier(X, _, _, _), !seen(X)", "?r(X)", "WITH RECURSIVE seen(y) AS (SELECT CAST(3 AS BIGINT) UNION SELECT y * 2 + 1 FROM seen WHERE y * 2 + 1 <= (SELECT max(s_suppkey) FROM supplier)) SELECT s_suppkey AS x FROM supplier WHERE s_suppkey NOT IN (SELECT y FROM seen)", 4),
    "same_generation": ("up(C, P) <- supplier(C, _, _, _), C > 0, Q = C - 1, H = Q / 3, P = floor(H)\nsg(X, Y) <- up(X, P), up(Y, P)\nsg(X, Y) <- up(X, A), sg(A, B), up(Y, B)", "?sg(7, Y)", "WITH RECURSIVE up AS (SELECT s_suppkey c, CAST(floor((s_suppkey - 1) / 3) AS BIGINT) p FROM supplier WHERE s_suppkey > 0), sg(x, y) AS (SELECT a.c, b.c FROM up a JOIN up b ON a.p = b.p UNION SELECT u.c, v.c FROM sg JOIN up u ON u.p = x JOIN up v ON v.p = y) SELECT CAST(7 AS BIGINT) AS _c0, y FROM sg WHERE x = 7", 4),
    "bill_of_materials": ("part_of(C, A, Q) <- supplier(C, _, N, _), C > 0, G = C - 1, H = G / 4, A = floor(H), Q = N % 3 + 1\nuses(A, C) <- part_of(C, A, _)\nuses(A, D) <- uses(A, C), part_of(D, C, _)\nr(A, count<C>) <- uses(A, C)", "?r(A, N)", "WITH RECURSIVE p AS (SELECT s_suppkey c, CAST(floor((s_suppkey - 1) / 4) AS BIGINT) a FROM supplier WHERE s_suppkey > 0), u(a, c) AS (SELECT a, c FROM p UNION SELECT u.a, p.c FROM u JOIN p ON p.a = u.c) SELECT a, count(*) AS n FROM u GROUP BY 1", 4),
    "reach_customers": ("link(N, R) <- nation(N, _, R)\nr(C, RN) <- customer(C, _, N, _, _), link(N, R), region(R, RN)", '?r(C, "ASIA")', "SELECT c_custkey AS c, 'ASIA' AS _c1 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'", 4),
    # --- changes
    "cond_delete": ("-supplier(S, N, K, B) <- supplier(S, N, K, B), B < 5000.0", "?supplier(S, N, K, B)", "SELECT s_suppkey AS s, s_name AS n, CAST(s_nationkey AS BIGINT) AS k, s_acctbal AS b FROM supplier WHERE NOT s_acctbal < 5000", 4),
    "update_rows": ("-nation(K, N, R), +nation(K, N, T) <- nation(K, N, R), R < 2, T = R + 100", "?nation(K, N, R)", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS n, CAST(CASE WHEN n_regionkey < 2 THEN n_regionkey + 100 ELSE n_regionkey END AS BIGINT) AS r FROM nation", 4),
    "insert_delete_facts": ('+region[(100, "NORTH"), (101, "SOUTH"), (0, "AFRICA")]\n-region(101, "SOUTH")', "?region(K, N)", "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS n FROM region UNION SELECT 100, 'NORTH'", 4),
    "session_overlay": ('region(200, "MOON")\nr(K, N) <- region(K, N), K > 2', "?r(K, N)", "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS n FROM region WHERE r_regionkey > 2 UNION SELECT 200, 'MOON'", 4),
    "text_filter": ('r(D, L) <- documents(D, T, "en", _, _), L = len(T), L > 3000', "?r(D, L)", "SELECT doc_id AS d, CAST(octet_length(encode(text)) AS BIGINT) AS l FROM documents WHERE lang = 'en' AND octet_length(encode(text)) > 3000", 4),
    "revenue_per_nation": ("rev(NN, sum<R>) <- lineitem(O, _, _, _, _, P, D, _, _, _, _), orders(O, C, _, _, _, _), customer(C, _, N, _, _), nation(N, NN, _), R = P * (1 - D)", "?rev(N, R)", "SELECT n_name AS n, round(sum(l_extendedprice * (1 - l_discount)), 1) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", 1),
}


def tables_of(program: str, goal: str) -> list[str]:
    """Test tables that the text names."""
    every = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    return [t for t in every.split() if re.search(rf"\b{t}\(|\b{t}\[", program + goal)]
