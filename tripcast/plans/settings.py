"""Settings of the workloads, as fixed values."""

WINDOW = 4                      # slots in a forecast input
SYNTHETIC_MULTIPLIER = 5        # synthetic trips per real trip
DATE_SEED = 23
COUNT_NOISE = 0.05
LONG_WINDOW, HORIZON = 8, 1     # zone forecast
CHOSEN_K, CHOSEN_RIDGE = 46, 0.0009980274958510734
PAIR_KS = (40, 45, 50)
PAIR_EPOCHS = (50, 80, 100, 150, 200, 250)
SWEEP_KS = (20, 25, 30, 35)
SWEEP_SHARE = 1e-4              # of the trips, in the reference's sweep
COMPACT_K, COMPACT_RIDGE = 33, 1e-4
COMPACT_SHARE = 0.5
BUSY_K = 27
TYPES = ("real", "synthetic", "real+synthetic")
