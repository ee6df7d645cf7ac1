"""A page fetcher over made-up logs: ten a block, so pages straddle blocks."""


def fetch(address, first, last, topic):
    logs = [
        {"blockNumber": hex(b), "blockHash": "", "transactionHash": f"0x{b}", "logIndex": hex(i), "address": address, "topics": [topic], "data": "0x", "timeStamp": hex(b * 2)}
        for b in range(first, min(last, first + 20) + 1)
        for i in range(10)
    ]
    return logs[:25]
