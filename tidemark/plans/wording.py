"""Names and sentences of reports, as their readers know them."""

from __future__ import annotations

ALGORITHM_NAMES = {
    "ALG-A1": "移動平均乖離率",
    "ALG-A2": "Hampel フィルタ",
    "ALG-A3": "Tukey の外れ値境界",
    "ALG-A4": "EWMA 管理図",
    "ALG-A5": "曜日・時刻別ベースライン",
    "ALG-B1": "短期/長期移動平均のクロス継続",
    "ALG-B2": "Mann-Kendall 傾向検定",
    "ALG-B3": "ローリング最小値の単調増加",
    "ALG-B4": "CUSUM",
    "ALG-B5": "線形回帰の傾き",
    "ALG-C1": "上限への張り付き",
}
ASPECTS = {"A": "観点1", "B": "観点2", "C": "観点3"}
WEEKDAYS = "月火水木金土日"
UNKNOWN, NONE_FOUND, NOTHING = "不明", "検知された異常はありません。", "(なし)"
NO_CAUSE, NO_OTHERS, NO_CROSS, NO_POINTS = "該当する候補なし (確度: —)", "  - (同じ時間帯に検知された他のアノマリーはありません)", "複数ホストにまたがる同時発生はありません。", "(データがありません)"
SAME_HOST, OTHER_HOST = "同一ホスト", "他ホスト"
MORE = "(ほか {n} 件)"
MORE_HOSTS = "(ほか {n} ホスト。脅威度の高い順に上位 {shown} 件のみ表示。全ホストのファイルは report_*_{ym}.md にある)"
MORE_PERIODS = "(全 {n} {unit}中、イベント数の多い上位 {shown} {unit}のみ表示)"
MORE_CROSS = "(ほか {n} 件。件数の多い順に上位 {shown} 件のみ表示)"
NOTES = {
    "rejects": ("読み飛ばした行", ("ファイル", "理由", "件数")),
    "skips": ("点数不足でスキップした系列", ("アルゴリズム", "理由", "スキップ系列数")),
    "failures": ("失敗したアルゴリズム", ("アルゴリズム", "系列", "メトリクス", "理由")),
}

#: By algorithm, with the names of its figures.
EXPLANATIONS = {
    "ALG-A1": "移動平均からの残差が {dev}σ に達した (閾値 {k_warn}σ/{k_fatal}σ)",
    "ALG-A2": "移動中央値からの残差が MAD の {dev} 倍に達した (閾値 {k})",
    "ALG-A3": "系列全体の四分位範囲から外れた (Q1={q1}, Q3={q3}, 値={value})",
    "ALG-A4": "前日同時刻との差分の指数加重移動平均が管理限界を超えた (z={z}, 限界={limit})",
    "ALG-A5": "同じ曜日・時刻帯の平常値から {z}σ 外れた (平常値={bucket_mu})",
    "ALG-B1": "短期移動平均が長期移動平均を {run_length} 点連続で上回った (下限 {min_run} 点)",
    "ALG-B2": "Mann-Kendall 検定で有意な増加傾向を検出した (S={S}, p={p}, Sen勾配={sen_slope_per_day}/日)",
    "ALG-B3": "{window_minutes}分窓のローリング最小値が連続{run_length}窓にわたり非減少で、下限が {floor_start} から {floor_end} へ上昇した (総増加 {total_rise})",
    "ALG-B4": "前日同時刻との差分の累積和が閾値を超えた (S+={s_plus}, h={h})",
    "ALG-B5": "線形回帰の傾きが 1 日あたり {slope_per_day}、決定係数 R²={r2} (総増加 {total_increase})",
    "ALG-C1": "{kind} {ceiling} の {ratio_pct}% ({threshold}) 以上が {held}続いた (期間中の平均 {avg_value}, 最大 {max_value}, {points} 点)",
}
PHENOMENA = {
    "spike_up": "平常時({baseline})に対し {ratio}倍({value})に跳ね上がった。前後の点は平常範囲",
    "spike_down": "平常時({baseline})に対し {ratio}({value})に落ち込んだ",
    "sustained": "{duration}にわたり平常範囲を上回った状態が継続した",
    "saturated": "{duration}にわたり{kind}({ceiling})の {ratio_pct}% 以上に張り付いた(期間中の平均 {avg_value}, 最大 {max_value})",
    "floor_rise": "最低値が{duration}上昇し、回復しない、{load}",
    "trend_up": "{duration}で {first}から{last}へ増加した(平均 {slope}/日)",
    "level_shift": "{end}を境に水準が {level_before}から{level_after}へ移行し、元に戻らない",
    "seasonal_dev": "{weekday}{hour}の平常値({bucket_mu})に対し {value}であった",
}
