"""Sentences of results. Each must be the same to the letter wherever results are compared."""

from __future__ import annotations

LOSSLESS_DROP = "Lossless drop detected on %d queue(s): PFC pauses present AND drops > 0 on the same queue. RDMA transport will retransmit and stall."
SUSTAINED_PAUSES = "Sustained PFC pause activity on %d queue(s) (>1000 frames in window). Receiver-side congestion is applying backpressure — investigate ECMP imbalance or incast at the sink."
ECN_ACTIVE = "ECN marking active on %d queue(s). DCQCN is throttling senders — fabric is healthy but congested."
BELOW_THRESHOLDS = "PFC/ECN counters present but below thresholds; fabric is signaling normally."
HIGH_UDP_SHARE = "High UDP share (%.0f%%) consistent with RoCE traffic, but no gNMI queue samples to confirm fabric health."
NO_STRESS = "No RoCE/RDMA stress signals in window."
LOSSY_DROPS = "Drops observed on %d queue(s) without PFC — lossy classes are dropping but the lossless plane appears intact. Verify QoS class mapping for RoCE traffic."
LINK_PEAK = "%s on %s peaked at %.1f%% utilization. The dominant conversation is %s -> %s (%s), accounting for %.1f%% of flow bytes."
NO_FLOWS = "No flow activity visible on %s:%s in the requested window. This usually means no sampled traffic reached the collector."
DERIVED_FROM = "Derived from %d util samples and %d flow groupings."
NO_ANOMALIES = "No anomalies detected in the requested window."
EXACT_STATE = "Exact (non-sampled) gNMI/OpenConfig snapshots."
BREACH = "%s on %s is at %.1f%% %s utilization."
SPIKE = "Traffic spike on %s (%s): %.2f GB in last {minutes} min vs baseline %.2f GB (Z=%.1f)."
QUEUE_DROP = "Lossless drop: queue %d on %s@%s has %d drops AND %d PFC pauses in last {minutes} min — RDMA transport will retransmit and stall."
QUEUE_STORM = "PFC pause storm on queue %d (%s@%s): %d pause frames in last {minutes} min — sustained receiver-side congestion."
QUEUE_ECN = "ECN marking spike on queue %d (%s@%s): %d marked packets in last {minutes} min — DCQCN is throttling senders."
