"""DuckDB SQL text for the correctness oracles of ``__spark_entry__.oracle_sql``.

These strings are an independent statement of each operator in plain SQL
(DuckDB dialect: 1-based lists, ``lambda x: ..`` syntax, ``list_reduce`` with
an initial value). The helpers only paste SQL fragments together for fixed
dimensions; nothing here is executed by the library itself.
"""

from __future__ import annotations

from segstate.functions.hashing import duck_md5_uniform
from segstate.sources.events import (BUCKET_DAYS, BUCKET_ORIGIN, LABEL_EVENT,
                                     LABELLED_ALPHABET, USER_ALPHABET)
from segstate.spec import HsmmSpec

NAN = "'nan'::DOUBLE"
NEG_INF = "'-inf'::DOUBLE"


def sql_list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def let(value: str, var: str, body: str) -> str:
    return f"list_transform([{value}], lambda {var}: {body})[1]"


def l1(vec: str, var: str) -> str:
    """F5 on a DuckDB list expression (``var`` names the bound list)."""
    norm = f"list_sum(list_transform({var}, lambda q_: abs(q_)))"
    return let(vec, var, f"CASE WHEN {norm} = 0 THEN {var} "
                         f"ELSE list_transform({var}, lambda q_: q_ / {norm}) END")


def ln(x: str) -> str:
    return (f"CASE WHEN isnan({x}) THEN {NAN} WHEN {x} > 0 THEN ln({x}) "
            f"WHEN {x} = 0 THEN {NEG_INF} ELSE {NAN} END")


# ---------------------------------------------------------------- sequences

def symbol_sql(alphabet) -> str:
    return f"CAST(list_position({sql_list(alphabet)}, event_type) - 1 AS INTEGER)"


def user_sequences_sql() -> str:
    """D1 with ``obs INTEGER[]``."""
    return (f"SELECT user_id AS workitem, "
            f"list({symbol_sql(USER_ALPHABET)} ORDER BY ts, event_id) AS obs "
            f"FROM events GROUP BY user_id")


def bucket_sql() -> str:
    return (f"CAST(floor(datediff('day', DATE '{BUCKET_ORIGIN}', CAST(ts AS DATE)) "
            f"/ {BUCKET_DAYS}) AS BIGINT)")


def labelled_sequences_sql() -> str:
    """D2 with ``obs INTEGER[]``."""
    sym = symbol_sql(LABELLED_ALPHABET)
    return (
        "SELECT workitem, cls, obs FROM ("
        f"SELECT CAST(user_id AS VARCHAR) || '-' || CAST(bucket AS VARCHAR) AS workitem, "
        f"CAST(max(CASE WHEN event_type = '{LABEL_EVENT}' THEN 1 ELSE 0 END) AS INTEGER) AS cls, "
        f"coalesce(list({sym} ORDER BY ts, event_id) "
        f"FILTER (WHERE event_type <> '{LABEL_EVENT}'), []::INTEGER[]) AS obs "
        f"FROM (SELECT *, {bucket_sql()} AS bucket FROM events) GROUP BY user_id, bucket"
        ") WHERE len(obs) > 0"
    )


def uniform_sql(key: str) -> str:
    return duck_md5_uniform(key)


def hash_sample_sql(fraction: float, seed: int, key: str = "workitem") -> str:
    return f"{uniform_sql(f'concat_ws(chr(58), {seed}, {key})')} < {float(fraction)}"


def obs_str_sql(obs: str) -> str:
    return f"array_to_string(list_transform({obs}, lambda x: CAST(x AS VARCHAR)), ';')"


# ------------------------------------------------------------------ models

def init_model_sql(spec: HsmmSpec, seed: int, fold: str = "fold", cls: str = "cls") -> str:
    """Select-list of F11 start parameters for the row's (fold, cls)."""
    def u(param, i, j):
        return uniform_sql(f"concat_ws(':', {seed}, {fold}, {cls}, '{param}', {i}, {j})")

    def grid(param, rows, cols):
        return (f"list_transform(range({rows}), lambda i_: list_transform(range({cols}), "
                f"lambda j_: {u(param, 'i_', 'j_')}))")

    pi = l1(f"list_transform(range({spec.m}), lambda i_: {u('pi', 'i_', 0)})", "v_")
    a = f"list_transform({grid('a', spec.m, spec.m)}, lambda r_: {l1('r_', 'w_')})"
    b = f"list_transform({grid('b', spec.m, spec.k)}, lambda r_: {l1('r_', 'w_')})"
    p = let(grid("p", spec.m, spec.d), "g_",
            "list_transform(g_, lambda r_: list_transform(r_, lambda x_: "
            "x_ * (1.0 / list_sum(flatten(g_)))))")
    return f"{pi} AS pi, {a} AS a, {b} AS b, {p} AS p"


# ----------------------------------------------------------------- forward

def forward_sql(obs: str, pi: str, a: str, b: str, p: str, spec: HsmmSpec) -> str:
    """R2/R3 as a DuckDB fold; returns the score expression."""
    m, keep = spec.m, spec.d - 1
    e = "[" + ", ".join(f"{b}[{j + 1}][o_ + 1]" for j in range(m)) + "]"

    def alpha_j(j: int) -> str:
        jj = j + 1
        terms = [f"0.0 * {p}[{jj}][1] * e_[{jj}]"]
        for d in range(1, keep + 1):
            u = " * ".join([f"e_[{jj}]"] + [f"eh_[{x}][{jj}]" for x in range(1, d + 1)])
            terms.append(f"(CASE WHEN len(eh_) >= {d} THEN "
                         f"acc_.ap[{d}][{jj}] * {p}[{jj}][{d + 1}] * ({u}) ELSE 0.0 END)")
        return " + ".join(terms)

    alpha = "[" + ", ".join(alpha_j(j) for j in range(m)) + "]"
    norm_alpha = "[" + ", ".join(
        f"CASE WHEN sc_ = 0 THEN al_[{i + 1}] ELSE al_[{i + 1}] * (1.0 / sc_) END"
        for i in range(m)) + "]"
    moved = "[" + ", ".join(
        "(" + " + ".join(["0.0"] + [f"an_[{i + 1}] * {a}[{i + 1}][{j + 1}]"
                                    for i in range(m) if i != j]) + ")"
        for j in range(m)) + "]"
    state = ("{'ap': list_prepend(" + l1(moved, "mv_") + f", acc_.ap)[1:{keep}], "
             "'eh': eh_, 'score': acc_.score + " + ln("sc_") + "}")
    body = let(norm_alpha, "an_", state)
    body = let("list_sum(al_)", "sc_", body)
    body = let(alpha, "al_", body)
    body = let(f"list_prepend(e_, acc_.eh)[1:{keep}]", "eh_", body)
    body = let(e, "e_", body)
    init = ("{'ap': [" + l1(pi, "pv_") + "], 'eh': []::DOUBLE[][], 'score': 0.0::DOUBLE}")
    return f"list_reduce({obs}, lambda acc_, o_: {body}, {init})['score']"


def prefix_sql(obs: str, t: int) -> str:
    return f"{obs}[1:{int(t)}]"


# ------------------------------------------------------ full E-step layers

def _vec(items) -> str:
    return "[" + ", ".join(items) + "]"


def _sum(terms) -> str:
    return "(" + " + ".join(terms) + ")"


def estep_layers_sql(base: str, spec: HsmmSpec) -> str:
    """Adds the per-sequence recursions to every row of ``base`` (columns obs,
    pi, a, b, p): e, u, alpha, ap, scale, beta, bp, n, xi, gamma, new_pi,
    new_a, new_b, new_p, loglik. Lists are 1-based; t is 1-based inside."""
    m, dd = spec.m, spec.d
    M = range(1, m + 1)
    D = range(1, dd + 1)  # 1-based duration column = d + 1
    # L1: emissions e[t][j]
    l1_ = f"SELECT *, list_transform(obs, lambda o_: {_vec(f'b[{j}][o_ + 1]' for j in M)}) AS e FROM ({base})"
    # L2: u[t][j][d+1]
    u_cell = ("CASE WHEN d_ = 0 THEN e[t_][j_] WHEN t_ - d_ >= 0 THEN list_reduce(list_transform(range(d_), "
              "lambda x_: e[t_ - x_][j_]), lambda q_, v_: q_ * v_, e[t_][j_]) ELSE 0.0 END")
    l2 = (f"SELECT *, list_transform(range(1, len(obs) + 1), lambda t_: list_transform(range(1, {m + 1}), "
          f"lambda j_: list_transform(range({dd}), lambda d_: {u_cell}))) AS u FROM ({l1_})")

    # L3: forward with full history (acc.ap[1] = alpha'(0))
    def al_raw(j):
        terms = [f"0.0 * p[{j}][1] * u[t_][{j}][1]"]
        for d in range(1, dd):
            terms.append(f"(CASE WHEN t_ - {d} >= 0 THEN acc_.ap[t_ - {d} + 1][{j}] * p[{j}][{d + 1}] "
                         f"* u[t_][{j}][{d + 1}] ELSE 0.0 END)")
        return _sum(terms)
    moved = _vec(_sum(["0.0"] + [f"an_[{i}] * a[{i}][{j}]" for i in M if i != j]) for j in M)
    fw_state = ("{'ap': list_append(acc_.ap, " + l1(moved, "mv_") + "), 'al': list_append(acc_.al, an_), "
                "'sc': list_append(acc_.sc, sc_)}")
    fw_body = let(_vec(f"CASE WHEN sc_ = 0 THEN ar_[{i}] ELSE ar_[{i}] * (1.0 / sc_) END" for i in M),
                  "an_", fw_state)
    fw_body = let("list_sum(ar_)", "sc_", fw_body)
    fw_body = let(_vec(al_raw(j) for j in M), "ar_", fw_body)
    fw_init = ("{'ap': [" + l1("pi", "pv_") + "], 'al': []::DOUBLE[][], 'sc': []::DOUBLE[]}")
    l3 = (f"SELECT *, list_reduce(range(1, len(obs) + 1), lambda acc_, t_: {fw_body}, {fw_init}) AS fw "
          f"FROM ({l2})")

    # L4: backward. State lists grow at the front: bt[d] = beta(t0 + d), bq[1] = beta'(t0 + 1)
    def bp_acc(t1: str, wrap: bool):
        # t1 = t0 + 1 (1-based index of u at t0); d = 0 reads beta(t0): 0, or 1.0 at the wrap
        terms = []
        for j in M:
            d0 = (f"p[{j}][1] * u[len(obs)][{j}][1] * 1.0" if wrap
                  else f"p[{j}][1] * u[{t1}][{j}][1] * 0.0")
            row = [d0]
            for d in range(1, dd):
                row.append(f"(CASE WHEN {d} <= len(bs_.bt) THEN p[{j}][{d + 1}] * u[{t1} + {d}][{j}][{d + 1}] "
                           f"* bs_.bt[{d}][{j}] ELSE 0.0 END)")
            terms.append(_sum(row))
        return _vec(terms)

    def beta_new(base_val: str):
        return _vec(_sum([base_val] + [f"a[{j}][{i}] * nb_[{i}]" for i in M if i != j]) for j in M)
    step = let(l1(bp_acc("t_ + 1", False), "ba_"), "nb_",
               "{'bt': list_prepend(" + l1(beta_new("0.0"), "bv_") + ", bs_.bt), "
               "'bq': list_prepend(nb_, bs_.bq)}")
    last = _vec(f"p[{j}][1] * u[len(obs)][{j}][1] * 1.0" for j in M)
    bw_init = ("{'bt': [" + _vec("1.0" for _ in M) + "], 'bq': [" + l1(last, "bl_") + "]}")
    l4 = (f"SELECT *, list_reduce(range(len(obs) - 2, -1, -1), lambda bs_, t_: {step}, {bw_init}) AS bw0 "
          f"FROM ({l3})")
    # final step t0 = -1 with the wrap of index -1 to T-1
    bs = "bw0"
    fin_acc = bp_acc("0", True).replace("bs_.", f"{bs}.")
    l5 = (f"SELECT *, {l1(fin_acc, 'fa_')} AS bp0 FROM ({l4})")
    beta_last = l1(beta_new("1.0").replace("nb_", "bp0"), "bz_")
    l6 = (f"SELECT * EXCLUDE (bw0, bp0), fw.al AS alpha, fw.ap AS ap, fw.sc AS scale, "
          f"list_concat(bw0.bt[1:len(obs) - 1], [{beta_last}]) AS beta, "
          f"list_prepend(bp0, bw0.bq) AS bp FROM ({l5})")

    # N, xi, gamma
    n_cell = ("CASE WHEN t_ - d_ >= 0 THEN ap[t_ - d_ + 1][i_] * p[i_][d_ + 1] * u[t_][i_][d_ + 1] "
              "* beta[t_][i_] ELSE 0.0 END")
    n_sql = (f"list_transform(range(1, len(obs) + 1), lambda t_: list_transform(range(1, {m + 1}), "
             f"lambda i_: {l1(f'list_transform(range({dd}), lambda d_: {n_cell})', 'nr_')}))")
    xi_sql = (f"list_transform(range(1, len(obs) + 1), lambda t_: list_transform(range(1, {m + 1}), "
              f"lambda i_: {l1(f'list_transform(range(1, {m + 1}), lambda j_: alpha[t_][i_] * a[i_][j_] * bp[t_ + 1][j_])', 'xr_')}))")
    g0 = l1(_vec(f"pi[{i}] * bp[1][{i}]" for i in M), "g0_")
    g_step = l1(_vec(f"gs_[len(gs_)][{i}] + ap[t_ + 1][{i}] * bp[t_ + 1][{i}] - alpha[t_][{i}] * beta[t_][{i}]"
                     for i in M), "gv_")
    g_mid = f"list_reduce(range(1, len(obs) - 1), lambda gs_, t_: list_append(gs_, {g_step}), [{g0}])"
    g_sql = (f"CASE WHEN len(obs) = 1 THEN [{l1('alpha[1]', 'ga_')}] "
             f"ELSE list_append({g_mid}, {l1('alpha[len(obs)]', 'gb_')}) END")
    l7 = f"SELECT *, {n_sql} AS n, {xi_sql} AS xi, {g_sql} AS gamma FROM ({l6})"

    # estimates
    def tsum(expr_t: str) -> str:
        return f"list_sum(list_transform(range(1, len(obs) + 1), lambda t_: {expr_t}))"
    new_a = _vec(l1(_vec(f"{tsum(f'xi[t_][{i}][{j}]')} / {_sum([tsum(f'xi[t_][{i}][{j2}]') for j2 in M])}"
                         for j in M), f"ra{i}_") for i in M)
    new_b = _vec(l1(_vec(f"{tsum(f'CASE WHEN obs[t_] = {v} THEN gamma[t_][{i}] ELSE 0.0 END')} / "
                         f"{tsum(f'gamma[t_][{i}]')}" for v in range(spec.k)), f"rb{i}_") for i in M)
    p_raw = _vec(_vec(f"{tsum(f'n[t_][{i}][{d}]')} / {_sum([tsum(f'n[t_][{i}][{d2}]') for d2 in D])}"
                      for d in D) for i in M)
    new_p = let(p_raw, "pr_", "list_transform(pr_, lambda r_: list_transform(r_, lambda x_: "
                              "x_ * (1.0 / list_sum(flatten(pr_)))))")
    new_pi = l1(_vec(f"gamma[1][{i}] / {_sum([f'gamma[1][{j}]' for j in M])}" for i in M), "np_")
    loglik = f"list_sum(list_transform(scale, lambda s_: {ln('s_')}))"
    return (f"SELECT *, {new_pi} AS new_pi, {new_a} AS new_a, {new_b} AS new_b, {new_p} AS new_p, "
            f"{loglik} AS loglik FROM ({l7})")
