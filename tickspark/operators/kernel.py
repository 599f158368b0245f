"""The account and its open orders, one tick at a time: for strategies whose orders depend on their state, and for streams."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

MAX_OPEN = 1024


@dataclass
class Account:
    cash: float
    position: int = 0
    average: float = 0.0
    realized: float = 0.0

    def fill(self, side: str, qty: int, fill_tick: int, tick_size: float, taker_bps: float, weighted: bool = True) -> None:
        """weighted: adding to a short averages by size; False reproduces the kernel's sign error there."""
        notional = (fill_tick * tick_size) * (qty / 1e6)
        fee = notional * (taker_bps / 10_000.0)
        old, sign = self.position, 1 if side == "BUY" else -1
        self.position = old + sign * qty
        self.cash += -(notional + fee) if sign > 0 else notional - fee
        if old == 0:
            self.average = float(fill_tick)
        elif (old > 0) == (sign > 0):
            if self.position:
                self.average = (old * self.average + (sign if weighted else 1) * qty * fill_tick) / self.position
        else:
            closed = min(abs(old), qty) / 1e6
            gain = closed * fill_tick * tick_size - closed * self.average * tick_size
            self.realized += gain if old > 0 else -gain
            if self.position == 0:
                self.average = 0.0
            elif (self.position > 0) != (old > 0):
                self.average = float(fill_tick)

    def unrealized(self, last_tick: int, tick_size: float) -> float:
        if self.position == 0:
            return 0.0
        units = self.position / 1e6
        return units * last_tick * tick_size - units * self.average * tick_size


@dataclass
class Order:
    order_seq: int
    order_type: str
    side: str
    qty_scaled: int
    limit_tick: int | None = None
    active: bool = True


@dataclass
class Engine:
    """place and cancel act between ticks; a tick fills the orders placed before it, in the order of their placement.

    Limits wait in heaps, so a tick costs by the orders that it fills and not by those that are open.
    """

    initial_cash: float
    taker_bps: float
    spread_bps: float
    tick_size: float
    weighted: bool = True
    #: Orders that may be tracked at once; None: any number.
    max_open: int | None = MAX_OPEN
    last_tick: int = 0
    ts_ms: int = 0
    fills: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.account = Account(self.initial_cash)
        self.orders: dict[int, Order] = {}  # by the number of their placement
        self._placed = 0
        self._market: list[int] = []
        self._buys: list[tuple[int, int]] = []  # (-limit, number)
        self._sells: list[tuple[int, int]] = []
        self._cancelled: list[int] = []

    def place(self, order: Order) -> int:
        """0, or -2 if as many orders are tracked as the kernel can; cancelled ones count until the next tick."""
        if order.order_type == "LIMIT" and order.limit_tick is None:
            raise ValueError("a LIMIT order needs a price")
        if self.max_open is not None and len(self.orders) >= self.max_open:
            return -2
        self._track(order)
        return 0

    def _track(self, order: Order) -> None:
        self.orders[self._placed] = order
        if not order.active:
            self._cancelled.append(self._placed)
        else:
            self._wait(self._placed, order)
        self._placed += 1

    def _wait(self, number: int, order: Order) -> None:
        if order.order_type == "MARKET":
            self._market.append(number)
        elif order.side == "BUY":
            heapq.heappush(self._buys, (-order.limit_tick, number))
        else:
            heapq.heappush(self._sells, (order.limit_tick, number))

    def cancel(self, order_seq: int) -> int:
        for n, o in self.orders.items():
            if o.active and o.order_seq == order_seq:
                o.active = False
                self._cancelled.append(n)
                return 0
        return -1

    def step(self, ts_ms: int, tick: int) -> int:
        """The number of fills of this tick."""
        self.ts_ms, self.last_tick, done = ts_ms, tick, 0
        if self._cancelled:
            self._drop_cancelled()
        due, self._market = self._market, []
        while self._buys and tick <= -self._buys[0][0]:
            due.append(heapq.heappop(self._buys)[1])
        while self._sells and tick >= self._sells[0][0]:
            due.append(heapq.heappop(self._sells)[1])
        for n in sorted(due):
            o = self.orders.pop(n, None)
            if o is None:  # cancelled
                continue
            base = tick if o.order_type == "MARKET" else o.limit_tick
            d = math.ceil(float(base) * (self.spread_bps / 10_000.0))
            price = base + d if o.side == "BUY" else base - d
            self.account.fill(o.side, o.qty_scaled, price, self.tick_size, self.taker_bps, self.weighted)
            self.fills.append((o.order_seq, ts_ms, o.side, o.qty_scaled, price))
            o.active, done = False, done + 1
        return done

    def _drop_cancelled(self) -> None:
        for n in self._cancelled:
            del self.orders[n]
        self._cancelled = []
        if len(self._buys) + len(self._sells) > 2 * len(self.orders) + 64:  # most of what waits was cancelled
            self._market, self._buys, self._sells = [], [], []
            for n, o in self.orders.items():
                self._wait(n, o)

    def state(self) -> list:
        """Account, last tick and tracked orders, as JSON can hold them."""
        a = self.account
        return [a.cash, a.position, a.average, a.realized, self.last_tick, self.ts_ms, [[o.order_seq, o.order_type, o.side, o.qty_scaled, o.limit_tick, o.active] for o in self.orders.values()]]

    def restore(self, state: list) -> None:
        """A new engine goes on from the state of another."""
        cash, position, average, realized, self.last_tick, self.ts_ms, orders = state
        self.account = Account(cash, position, average, realized)
        for o in orders:
            self._track(Order(*o))

    def snapshot(self) -> dict:
        a = self.account
        u = a.unrealized(self.last_tick, self.tick_size)
        mtm = a.cash + a.position / 1e6 * self.last_tick * self.tick_size
        return {"ts_ms": self.ts_ms, "cash": a.cash, "position": a.position / 1e6, "avg_entry_price": a.average, "realized_pnl": a.realized, "unrealized_pnl": u, "equity": a.cash + u, "equity_mtm": mtm}
