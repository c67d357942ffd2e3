"""Explicit schemas of the landed files; nothing is ever inferred."""

MARKET = """struct<id:string, conditionId:string, question:string, slug:string, description:string,
resolutionSource:string, outcomes:string, outcomePrices:string, clobTokenIds:string,
liquidity:string, liquidityNum:double, liquidityClob:double, volume:string, volumeNum:double,
volumeClob:double, volume24hr:double, volume24hrClob:double, volume1wk:double, spread:double,
bestBid:double, bestAsk:double, lastTradePrice:double, startDate:string, startDateIso:string,
endDate:string, endDateIso:string, active:boolean, closed:boolean, archived:boolean,
acceptingOrders:boolean, enableOrderBook:boolean, negRisk:boolean, gameStartTime:string,
sportsMarketType:string>"""
MARKETS = MARKET.removeprefix("struct<").removesuffix(">").replace(":", " ")
EVENTS = f"""id string, slug string, title string, openInterest double,
tags array<struct<id:string, label:string, slug:string>>, markets array<{MARKET}>"""
POSITIONS = """proxyWallet string, asset string, conditionId string, size double, avgPrice double,
initialValue double, currentValue double, cashPnl double, percentPnl double, totalBought double,
realizedPnl double, curPrice double, redeemable boolean, mergeable boolean, negativeRisk boolean,
title string, slug string, eventSlug string, outcome string, outcomeIndex int, endDate string"""
CLOSED_POSITIONS = """proxyWallet string, asset string, conditionId string, avgPrice double,
totalBought double, realizedPnl double, curPrice double, title string, slug string,
eventSlug string, outcome string, outcomeIndex int, endDate string, timestamp bigint"""
ACTIVITY = """proxyWallet string, timestamp bigint, conditionId string, type string, size double,
usdcSize double, price double, asset string, side string, outcomeIndex int, transactionHash string,
title string, slug string, eventSlug string, outcome string, name string, pseudonym string"""
TRADES = """proxyWallet string, side string, asset string, conditionId string, size double,
price double, timestamp bigint, transactionHash string, outcome string, outcomeIndex int,
name string, taker boolean"""
HOLDERS = """conditionId string, token string, holders array<struct<proxyWallet:string,
asset:string, amount:double, outcomeIndex:int, name:string, displayUsernamePublic:boolean>>"""
LEADERBOARD = "rank string, proxyWallet string, userName string, vol double, pnl double"
PRICE_HISTORY = "token string, history array<struct<t:double, p:double>>"
BOOKS = """asset_id string, timestamp string, bids array<struct<price:string, size:string>>,
asks array<struct<price:string, size:string>>"""
PORTFOLIO = "user string, value array<struct<value:double>>, traded int"
FILLS = """trader_id bigint, market_id bigint, outcome_index int, side string, size double,
price double, usd double, ts bigint, dedupe_key string"""
