"""The study as one configuration, proxy inputs and the registered queries."""
