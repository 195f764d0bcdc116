"""Declared schemas of the filing and market tables, and of the analysis document."""

from __future__ import annotations

from pyspark.sql.types import StructType

TABLES: dict[str, str] = {
    "company": "id string, ticker string, name string, cik string, sector string, industry string, current_price double, fifty_two_week_high double, fifty_two_week_low double, market_cap double, analyst_target_price double, pe_ratio double, forward_pe double, dividend_yield double, beta double, volume bigint, average_volume bigint, analyst_rating double, analyst_rating_count int, latest_revenue double, latest_revenue_yoy double, latest_net_income double, latest_net_income_yoy double, latest_gross_margin double, latest_operating_margin double, updated_at timestamp",
    "filing": "id string, accession_number string, filing_type string, cik string, company_id string, filing_url string, filing_date timestamp, report_date timestamp, analysis_data string, ai_summary string, risk_score double, sentiment_score double, concern_level double, predicted_7d_return double, predicted_30d_return double, predicted_30d_alpha double, prediction_confidence double, actual_7d_return double, actual_30d_return double, actual_7d_alpha double, actual_30d_alpha double, consensus_eps double, actual_eps double, eps_surprise double, consensus_revenue double, actual_revenue double, revenue_surprise double",
    "price": "ticker string, date date, open double, high double, low double, close double, volume bigint",
    "prediction": "id string, filing_id string, features string, predicted_return double, confidence double, model_version string, created_at timestamp",
    "user": "id string, email string, name string, tier string",
    "job_run": "id string, job_name string, status string, started_at timestamp, completed_at timestamp, filings_fetched int, filings_stored int, companies_processed int, error_message string",
    "snapshot": "id string, company_id string, snapshot_date timestamp, trigger_type string, filing_id string, current_price double, market_cap double, pe_ratio double, analyst_target_price double, fifty_two_week_high double, fifty_two_week_low double, eps_estimate double",
    "technical": "ticker string, date date, ma30 double, ma50 double, ma200 double, price_to_ma30 double, price_to_ma50 double, price_to_ma200 double, rsi14 double, rsi30 double, macd double, macd_signal double, macd_histogram double, atr14 double, volatility30 double, return_7d double, return_30d double, return_90d double, volume_ma30 double, volume_ratio double",
    "macro": "date date, spx_close double, spx_return_7d double, spx_return_14d double, spx_return_21d double, spx_return_30d double, vix_close double, vix_ma30 double, fed_funds_rate double, treasury_3m double, treasury_2y double, treasury_10y double, yield_curve_2y10y double, fed_funds_change_30d double, treasury_10y_change_30d double",
    "portfolio": "id string, name string, starting_capital double, current_cash double, total_value double, total_return double, win_rate double, sharpe_ratio double, max_drawdown double, max_position_size double, min_confidence double, total_trades int, winning_trades int, losing_trades int, is_active boolean",
    "trade": "id string, portfolio_id string, ticker string, filing_id string, direction string, status string, entry_date timestamp, exit_date timestamp, entry_price double, entry_value double, exit_price double, exit_value double, shares int, realized_pnl double, realized_pnl_pct double, predicted_return double, confidence double, actual_return double, entry_commission double, exit_commission double",
    "portfolio_snapshot": "portfolio_id string, date date, total_value double, cash double, positions_value double, daily_pnl double, daily_pnl_pct double, cumulative_pnl double",
    "analyst_event": "id string, company_id string, activity_date timestamp, firm string, action_type string, previous_rating string, new_rating string, previous_target double, new_target double, source string",
    "watchlist": "user_id string, ticker string",
    "sector_watch": "user_id string, sector string",
    "alert": "id string, user_id string, alert_type string, ticker string, sector string, enabled boolean, frequency string, delivery_time string, min_concern_level double, min_predicted_return double",
}

ANALYSIS = (
    "risks struct<overallTrend:string,riskScore:double,priorRiskScore:double,topChanges:array<string>>, "
    "sentiment struct<sentimentScore:double,confidence:double,tone:string,keyPhrases:array<string>,toneShift:string>, "
    "concernAssessment struct<concernLevel:double,concernLabel:string,netAssessment:string,concernFactors:array<string>,positiveFactors:array<string>,reasoning:string>, "
    "financialMetrics struct<revenueGrowth:string,marginTrend:string,guidanceDirection:string,guidanceDetails:string,keyMetrics:array<string>,surprises:array<string>,guidanceComparison:struct<change:string,details:string>,"
    "structuredData:struct<revenue:double,revenueYoY:string,netIncome:double,netIncomeYoY:string,eps:double,epsYoY:string,grossMargin:double,operatingMargin:double,peRatio:double,marketCap:double,sector:string,industry:string,consensusEPS:double,consensusRevenue:double,epsSurprise:string,epsSurpriseMagnitude:double,revenueSurprise:string,revenueSurpriseMagnitude:double>>, "
    "analyst struct<consensusScore:double,upsidePotential:double,numberOfAnalysts:int,targetPrice:double,activity:struct<upgradesLast30d:int,downgradesLast30d:int,netUpgrades:int,majorUpgrades:int,majorDowngrades:int>>, "
    "summary string, filingContentSummary string, guidance string, "
    "xbrlFinancials struct<revenue:double,netIncome:double,totalAssets:double,totalLiabilities:double,earningsPerShareDiluted:double,earningsPerShareBasic:double>"
)


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])
